"""Typed normalisation of the flat frame by the contract's declared types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..plans.contract import CROSSWALKS, Contract, Field
from ..sources.checkpoint import kept
from .pipeline import Flat, pipeline_columns


def enum(c: Column, target: Field) -> Column:
    """By the crosswalk of the field's kind, or else by the allowed value whose words are the same."""
    words = CROSSWALKS.get(target.kind)
    pairs = words if words is not None else {" ".join(a.lower().replace("_", " ").replace("-", " ").replace("/", " ").replace(".", " ").split()): a for a in reversed(target.allowed)}
    return F.when(~text.blank(c), text.lookup(text.token(c), pairs))


def normalised(c: Column, target: Field) -> Column:
    kind = target.data_type
    if kind in ("text", "identifier"):
        return text.clean(c)
    return {"date": lambda: dates.free(c), "enum": lambda: enum(c, target), "email": lambda: text.email(c), "phone": lambda: text.phone(c), "numeric": lambda: text.number(c), "boolean": lambda: text.boolean(c)}[kind]()


def normalize(df: DataFrame, contract: Contract) -> DataFrame:
    """df with every logical field typed, and its value before as raw__<field>. Fields that are missing come as nulls."""
    fields = [f for f in contract.by_name.values() if not f.generated]
    raw = {f.name: F.col(f.name) if f.name in df.columns else F.lit(None).cast("string") for f in fields}
    df = df.withColumns({f"raw__{n}": c for n, c in raw.items()})
    return df.withColumns({f.name: normalised(F.col(f"raw__{f.name}"), f) for f in fields})


def written(flat: Flat, contract: Contract, write: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """normalize(flat.df), written once. Of pipelines without steps only the source columns and the typed fields are: the pipelines' results and the raw__ columns are the source's values again.

    write: what writes the rows and reads them back; it may number them.
    """
    typed = normalize(flat.df, contract)
    if any(m.steps for m in flat.mappings):
        return write(typed)
    fields = [f.name for f in contract.by_name.values() if not f.generated]
    sources = [F.col(f"`src__{c}`") for c in flat.columns]
    rows = write(typed.select("source_row_number", *sources, *[F.col(f).alias(f"typed__{f}") for f in fields]))
    rows = pipeline_columns(rows, flat.mappings, False, {c: f"src__{c}" for c in flat.columns})
    first = {m.field: f"_p{k}" for k, m in reversed(list(enumerate(flat.mappings)))}
    raw = {f: F.col(first[f])["v"] if f in first else F.lit(None).cast("string") for f in fields}
    return rows.select("source_row_number", *sources, *[f"_p{k}" for k in range(len(flat.mappings))], *[c.alias(f"raw__{f}") for f, c in raw.items()], *[F.col(f"typed__{f}").alias(f) for f in fields])
