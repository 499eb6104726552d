"""Errors of the library. What fails for a single file becomes a row, not an exception."""


class CorpusError(Exception):
    """Any of these."""


class ConfigError(CorpusError):
    """Settings that can't be used."""


class DecodeError(CorpusError):
    """A file that its decoder can't read; a decoder may raise it, and the file's row has it as an error."""


class PackError(CorpusError):
    """A pack that can't be read or written."""


class ValidationError(CorpusError):
    """Rows that break a rule."""
