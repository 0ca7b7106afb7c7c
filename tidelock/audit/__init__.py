"""Findings, rules, settings, code analysis, engine and reports."""
