"""Tokenizers for scripts without spaces, registered by name, and the identity of the rules in effect.

Without one, CJK runs are indexed by bigrams (``functions.text``) and Thai runs as words.  A registered function takes a run of one script
and returns its words; it is applied to the runs of its script alone, a batch at a time.  An index stores the fingerprint that it was
built with; another one means that it should be built anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T

RULES_VERSION = 2
SCRIPTS = {"chinese": "\u4e00-\u9fff", "thai": "\u0e00-\u0e7f"}


@dataclass
class Tokenizers:
    held: dict[str, tuple[str, Callable[[str], list[str]], str]] = field(default_factory=dict)

    def register(self, name: str, script: str, split: Callable[[str], list[str]], version: str = "1") -> None:
        if script not in SCRIPTS:
            raise ValueError(f"script must be one of {sorted(SCRIPTS)}: {script}")
        self.held[script] = (name, split, version)

    def fingerprint(self) -> str:
        parts = [f"{name}/{version}" for _, (name, _, version) in sorted(self.held.items())] or ["unicode/builtin"]
        return "+".join(parts) + f"/rules{RULES_VERSION}"

    def index_tokens(self, text: Column) -> Column:
        """``text.index_tokens``, with runs of registered scripts cut by their own function."""
        plain = T.index_tokens(text)
        if not self.held:
            return plain
        held = {script: split for script, (_, split, _) in self.held.items()}
        any_script = "".join(SCRIPTS[s] for s in held)
        patterns = {s: re.compile(f"[{SCRIPTS[s]}]+") for s in held}

        def cut(word: str) -> list[str]:
            out, at = [], 0
            found = sorted((m.start(), m.end(), s) for s, p in patterns.items() for m in p.finditer(word))
            for a, b, script in found:
                out += [word[at:a]] if a > at else []
                out += [x for x in held[script](word[a:b]) if x.strip()]
                at = b
            return out + ([word[at:]] if at < len(word) else [])

        def run(words: pd.Series) -> pd.Series:
            return words.map(lambda ws: None if ws is None else [x for w in ws for x in cut(w)])

        run.__annotations__ = {"words": pd.Series, "return": pd.Series}
        return F.when(text.rlike(f"[{any_script}]"), F.pandas_udf(run, "array<string>")(T.words(text))).otherwise(plain)
