"""Text analysis: tokenizer, lower-casing, length limit, stop words."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard tokenizer keeps runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes terms. Terms over ``max_length`` characters are dropped."""

    tokenizer: str = "standard"
    lowercase: bool = True
    max_length: int | None = None
    stop_words: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.tokenizer not in ("standard", "whitespace", "keyword"):
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}")

    @classmethod
    def from_manifest(cls, analyzer: dict | None) -> Analyzer:
        """Read ``{tokenizer, filter: [...]}``, whose filters are names or objects (also as JSON text)."""
        if not analyzer:
            return cls()
        steps = analyzer.get("filter") or []
        steps = steps if isinstance(steps, list) else [steps]
        lowercase, longest, stops = False, None, ()
        for step in steps:
            if isinstance(step, str) and step.lstrip().startswith("{"):
                step = json.loads(step)
            if step == "lowercase":
                lowercase = True
            elif isinstance(step, dict) and step.get("type") == "length":
                longest = step.get("max")
            elif isinstance(step, dict) and step.get("type") == "stop":
                words = step.get("stop_words") or []
                stops = tuple(words.split(",") if isinstance(words, str) else map(str, words))
        return cls(analyzer.get("tokenizer") or "standard", lowercase, longest, stops)

    def terms(self, text: Column) -> Column:
        """Array of terms, repeats kept."""
        source = F.coalesce(text, F.lit(""))
        source = F.lower(source) if self.lowercase else source
        if self.tokenizer == "standard":
            out = F.regexp_extract_all(source, F.lit(WORD), F.lit(0))
        elif self.tokenizer == "whitespace":
            out = F.filter(F.split(source, r"\s+"), lambda t: t != "")
        else:
            out = F.filter(F.array(source), lambda t: t != "")
        if self.max_length is not None:
            limit = self.max_length
            out = F.filter(out, lambda t: F.length(t) <= limit)
        if self.stop_words:
            stops = self.stop_words
            out = F.filter(out, lambda t: ~t.isin(*stops))
        return out
