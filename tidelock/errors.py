"""Errors of the engine."""


class AuditError(Exception):
    """Any error that the engine raises on purpose."""


class DataError(AuditError):
    """Data that cannot be used."""


class ConfigError(AuditError):
    """Settings that are not allowed."""


class StrategyError(AuditError):
    """A strategy that cannot be run."""
