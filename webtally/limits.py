"""Bounds on what is kept or shown. All are off unless a caller asks for them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple


class Limits(NamedTuple):
    """Characters of each value, ``None`` for all of them; ``entries`` bounds briefing sections by name."""

    evidence: int | None = None  # evidence of a finding, marked with "..." where cut
    key: int | None = None  # evidence that tells two findings of a rule in a file apart
    value: int | None = None  # value of a variable, marked with "..." where cut
    banner: int | None = None  # start of a file that is searched for version banners
    context: int | None = None  # line of a source or sink
    hint: int | None = None  # data-flow hint
    entries: Mapping[str, int] = {}
    shown_value: int | None = None  # variable value in a briefing
    shown_evidence: int | None = None  # evidence in a briefing
    shown_context: int | None = None  # source or sink line in a briefing
    content: int | None = None  # file content in a prompt


NONE = Limits()
