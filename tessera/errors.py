"""Errors of the library, all of one base."""


class TesseraError(Exception):
    """Base of all errors that this library raises by itself."""


class ConfigurationError(TesseraError):
    """A setting is out of range or unknown."""


class DatasetError(TesseraError):
    """A dataset can't be registered or read."""


class ProposalError(TesseraError):
    """A proposer's answer can't be read."""


class ExecutionError(TesseraError):
    """A feature program or expression failed."""


class UnsafeExpressionError(ExecutionError):
    """An expression or program uses what isn't allowed."""


class ExecutionTimeout(ExecutionError):
    """A feature program ran too long."""


class EvaluationError(TesseraError):
    """A metric or model is unknown, or a score can't be computed."""


class PlanError(TesseraError):
    """No part of a round could be computed."""


class ClientError(TesseraError):
    """A model client failed for good."""
