"""Expressions and canonical values as Spark columns."""
