"""A feed: how its landed rows are guarded, normalised and checked.

``rows`` turns landed documents into raw rows (an explode), ``normalize`` turns
raw rows into the typed table; both are lazy and take any number of rows.
``load`` adds the guards that stop a bad document before anything is stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from basinframe.operators.contracts import Contract, Guard, guard, require_rows


@dataclass(frozen=True)
class Feed:
    source_id: str
    contract: Contract
    normalize: Callable[..., DataFrame]
    rows: Callable[[DataFrame], DataFrame] = lambda df: df
    document_guards: Callable[[], Sequence[Guard]] = tuple
    row_guards: Callable[[], Sequence[Guard]] = tuple

    def load(self, landed: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda out: out, **kw) -> DataFrame:
        """The table of landed documents; ``keep`` may store it before its contract reads it."""
        guard(landed, self.source_id, self.document_guards(), empty="nothing landed")
        raw = self.rows(landed)
        guard(raw, self.source_id, self.row_guards(), empty="document has no rows")
        out = keep(self.normalize(raw, **kw))
        return self.contract.enforce(require_rows(out, self.source_id))


def at_of(docs: DataFrame) -> list[str]:
    """The column of a record's place in its file, where documents are single records."""
    return ["at"] if "at" in docs.columns else []
