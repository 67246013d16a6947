"""Token counts of a SentencePiece model with a whole-token shortcut.

The text is cut where no piece can span: before each run of U+2581 (the model's blank) and around line feeds. Both are
proved from the vocabulary when the table is built: no piece has U+2581 after another character, and none but
a byte piece has a line feed. A unit that the table lists encodes alone as one token (each was encoded once to prove
it), so it counts directly; only the other units are merged by the library. The table is built once, on the driver, and sent
to the tasks; its size is the vocabulary's.

Null and empty texts have no tokens. Very long units go to the library whole. Rows don't affect each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: Units whose counts a worker remembers at most.
REMEMBERED = 400_000


class TokenCounter:
    """Counts tokens of texts; knows which units are whole tokens."""

    def __init__(self, model_file: str, whole: frozenset[str] | None = None):
        """`whole`: units already proved to be whole tokens; else the proof is made here."""
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.counts: dict[str, int] = {}
        self.whole = self.proved() if whole is None else whole

    def proved(self) -> frozenset[str]:
        """Units that encode alone as one token; fails if texts can't be cut into units."""
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not self._special(i)]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("a piece spans a blank or a line feed: texts can't be cut there")
        if self.model.encode("a b") != self.model.encode("a") + self.model.encode("b"):
            raise ValueError("the model doesn't put a blank before each text")
        return frozenset(p for p in pieces if UNIT.fullmatch(p) and self.merged(p) == 1) | {BLANK}

    def _special(self, i: int) -> bool:
        return self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)

    def merged(self, unit: str) -> int:
        """Tokens of a unit by the library, which puts a blank before the text."""
        if unit[0] == BLANK:
            return len(self.model.encode(unit[1:])) if len(unit) > 1 else 1
        return len(self.model.encode("\n" + unit)) - 2

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        units = UNIT.findall(BLANK + text.replace(" ", BLANK))
        rest = [u for u in units if u not in self.whole]
        counts, total = self.counts, len(units) - len(rest)
        if len(counts) > REMEMBERED:
            counts.clear()
        for u in rest:
            n = counts.get(u)
            if n is None:
                n = self.merged(u)
                if len(u) < 64:
                    counts[u] = n
            total += n
        return total


def token_counts(text: Column, model_file: str) -> Column:
    """Number of tokens of each text, as the library gives them."""
    whole = TokenCounter(model_file).whole

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(model_file, whole)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return run(text)
