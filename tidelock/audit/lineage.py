"""Fingerprints of tables and the ordered steps of an audit."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import canonical_hash


def row_sums(df: DataFrame) -> DataFrame:
    """One row: n, and the sum over all rows of 60 bits of each row's MD5 (of its columns as text, nulls marked). Partial sums in each task; rows carry their keys, so their order does not count."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(bits), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def fingerprint(df: DataFrame) -> str:
    """SHA-256 of the schema, the number of rows and their summed digests."""
    r = row_sums(df).first()
    return canonical_hash({"schema": df.dtypes, "n": r["n"], "digest": str(r["digest"])})


@dataclass
class Step:
    step: str
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


@dataclass
class Lineage:
    steps: list[Step] = field(default_factory=list)

    def record(self, step: str, **parts) -> Step:
        self.steps.append(Step(step, **parts))
        return self.steps[-1]

    def to_list(self) -> list[dict]:
        return [asdict(s) for s in self.steps]
