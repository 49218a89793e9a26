"""Errors that callers can tell apart; plain argument mistakes are ``ValueError``."""


class VectrillError(Exception):
    """Base class of every error of this library."""


class CollectionNotFoundError(VectrillError, FileNotFoundError):
    """The collection isn't there and was not to be created, or it was deleted under an open handle."""


class UnsupportedFilterError(VectrillError):
    """A filter asks for something outside the filter language; nothing is ever dropped silently."""


class DimensionMismatchError(VectrillError):
    """A vector has the wrong width, or a width is not a positive multiple of 8."""


class EmbedderRequiredError(VectrillError):
    """Text was given to a collection without an embedder."""


class EmbedderIdentityMismatchError(VectrillError):
    """The embedder is not the one whose vectors the collection holds."""


class EmbedderMismatchError(VectrillError):
    """The collection has rows but no record of an embedder, so text can't be embedded safely."""


class CorruptedMetadataError(VectrillError):
    """A manifest is missing, unreadable or contradicts itself."""


class WriteConflictError(VectrillError):
    """Other writers kept winning the commit until the lock timeout was over."""
