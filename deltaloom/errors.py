"""Coded errors. Callers branch on ``code``; texts may change."""

from __future__ import annotations


class ViewError(Exception):
    code = "IV000"

    def __init__(self, message: str, detail: str | None = None, hint: str | None = None):
        super().__init__(f"{self.code}: {message}" + (f" ({detail})" if detail else ""))
        self.message, self.detail, self.hint = message, detail, hint


class Lagged(ViewError):
    """The cursor is older than the oldest kept change."""

    code = "IV001"


class Stale(ViewError):
    """The view can't be kept current; a refresh rebuilds it."""

    code = "IV002"


class EpochChanged(ViewError):
    """The view was rebuilt since the cursor was taken."""

    code = "IV003"


class Unsupported(ViewError):
    """The definition is outside of what can be kept current."""

    code = "IV004"


class DirectWrite(ViewError):
    """Views are written by the engine only."""

    code = "IV005"


class BuildFailed(ViewError):
    """The view could not be built."""

    code = "IV006"


class NotFound(ViewError):
    """No view or table of that name."""

    code = "IV404"


class Conflict(ViewError):
    """Another engine on the same folder was first; what was done is undone."""

    code = "IV408"


class Exists(ViewError):
    """The name is taken."""

    code = "IV409"
