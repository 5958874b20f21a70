"""Lookups on normalised keys that append columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registryloom.functions.text import norm_key, or_empty
from registryloom.names import Names, col
from registryloom.operators.clean import clean_table, remove_punctuation
from registryloom.operators.schema import coerce_numbers, replace_columns

_LKEY, _RKEY, _NEXT = "__lookup_left", "__lookup_right", "__next_key"
_MAPKEY, _HIT, _MISSED = "__map_key", "__map_hit", "__missed"

# Fixed value: the segment of names that no lookup row covers.
DEFAULT_SEGMENT = "Others"
BROADCAST_BYTES = 32 * 1024 * 1024


def clean_lookup(
    lookup: DataFrame,
    columns: Iterable[str] | None = None,
    *,
    title_case: bool = True,
    punct: bool = True,
    numbers: Iterable[str] = (),
) -> DataFrame:
    """Fill and clean a lookup table; values are cleaned along with keys.

    Text columns named in ``numbers`` become numbers first, so that the text rules spare them.
    """
    columns = list(columns or [])
    out = clean_table(
        coerce_numbers(lookup, numbers), columns, case_mode="title" if title_case else "none", drop_rows=False
    )
    return remove_punctuation(out, columns) if punct else out


def row_bytes(df: DataFrame) -> Column:
    """About the memory that a row takes: its text, and 16 bytes for each cell and the row."""
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    per_row = F.lit(16 * (len(df.columns) + 1))
    return reduce(lambda a, n: a + F.coalesce(F.octet_length(col(n)), F.lit(0)), text, per_row)


def broadcast_small(*tables: DataFrame, max_bytes: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Mark the tables whose measured size fits a broadcast; the others join by shuffle.

    One job, run when this is called, sums rows and text bytes; the estimate allows 16 bytes per
    other cell. A caller who knows the sizes can mark tables with ``F.broadcast`` instead.
    """

    def size(i: int, t: DataFrame) -> DataFrame:
        return t.agg(F.lit(i).alias("i"), F.coalesce(F.sum(row_bytes(t)), F.lit(0)).alias("n"))

    sizes = reduce(DataFrame.unionAll, [size(i, t) for i, t in enumerate(tables)]).collect()
    fits = {r["i"] for r in sizes if r["n"] <= max_bytes}
    return [F.broadcast(t) if i in fits else t for i, t in enumerate(tables)]


def _append(
    df: DataFrame,
    left_key: Column,
    lookup: DataFrame,
    right_key: Column,
    add: list[str],
) -> DataFrame:
    clash = [n for n in add if n in df.columns]
    if clash:
        raise ValueError(f"lookup columns {clash} are already in the left table")
    right = lookup.select(right_key.alias(_RKEY), *[col(n) for n in add])
    keyed = df.withColumn(_LKEY, left_key)
    return keyed.join(right, F.col(_LKEY).eqNullSafe(F.col(_RKEY)), "left").drop(_LKEY, _RKEY)


def _key_of(df: DataFrame, name: str, mode: str) -> Column:
    """Keys never have punctuation, however the tables were cleaned."""
    if name not in df.columns:
        raise ValueError(f"no lookup key column {name!r}; there are {df.columns}")
    return norm_key(col(name), mode=mode)


def lookup_append(
    df: DataFrame,
    lookup: DataFrame,
    *,
    left_key: str,
    right_key: str | None = None,
    add_columns: list[str] | None = None,
    mode: str = "compat",
) -> DataFrame:
    """Left join on the normalised key; appends ``add_columns`` (all but the key if none given).

    Repeated lookup keys multiply rows. NULL matches NULL; an absent key column is an error, as
    it would join every row with every other. No hint is set here: pass the lookup through ``broadcast_small`` first, or leave the
    choice to the optimizer.
    """
    right_key = right_key or left_key
    if add_columns is None:
        add_columns = [n for n in lookup.columns if n != right_key]
    return _append(
        df,
        _key_of(df, left_key, mode),
        lookup,
        _key_of(lookup, right_key, mode),
        add_columns,
    )


def fill_default(df: DataFrame, name: str, default: str = DEFAULT_SEGMENT) -> DataFrame:
    """NULL and '' become the default."""
    filled = F.when(or_empty(col(name)) == "", F.lit(default)).otherwise(col(name))
    return replace_columns(df, {name: filled})


@dataclass(frozen=True)
class PreparedChain:
    """The three lookup tables as one, so that trials meet a single table of known size.

    ``table`` holds the appended columns by map key. ``unmatched`` holds what trials without a row
    in the map get: the segments of a NULL name, or nothing. Without ``table`` the tables depend on
    columns of the trials and are joined one by one. Building plans with ``append`` runs no job, so
    it also serves rows that are still arriving.
    """

    left_key: str
    mode: str
    added: tuple[str, ...]
    defaults: tuple[str, ...]
    table: DataFrame
    unmatched: DataFrame | None = None

    def append(self, df: DataFrame) -> DataFrame:
        out = _append(df, _key_of(df, self.left_key, self.mode), self.table, col(_MAPKEY), [*self.added, _HIT])
        if self.unmatched is not None:
            own = [col(n).alias(_MISSED + n) for n in self.unmatched.columns if n != _NEXT]
            missed = F.when(col(_HIT).isNull(), F.lit(1))
            out = out.join(self.unmatched.select(*own, F.lit(1).alias(_MISSED)), missed == col(_MISSED), "left")
            held = [n for n in self.unmatched.columns if n != _NEXT]
            out = replace_columns(out, {n: F.when(col(_HIT).isNull(), col(_MISSED + n)).otherwise(col(n)) for n in held})
            out = out.drop(_MISSED, *[_MISSED + n for n in held])
        out = out.drop(_HIT)
        for name in self.defaults:
            out = fill_default(out, name)
        return out


def prepare_chain(
    sponsor_map: DataFrame,
    us_segments: DataFrame,
    ww_segments: DataFrame,
    *,
    names: Names = Names(),
    map_left_key: str | None = None,
    map_right_key: str | None = None,
    us_key: str | None = None,
    ww_key: str | None = None,
    map_add: list[str] | None = None,
    us_add: list[str] | None = None,
    ww_add: list[str] | None = None,
    cleanse: bool = True,
    title_case: bool = True,
    punct: bool = True,
    numbers: Iterable[str] = (),
    mode: str = "compat",
    broadcast_bytes: int | None = None,
    root: str | None = None,
) -> PreparedChain:
    """Join the lookup tables with each other, for any number of trial tables and streams.

    Options are those of ``lookup_chain``; the map must add the standard name. With
    ``broadcast_bytes`` the tables are measured here, once. With ``root`` the result is written
    there and read from there, so that it stays as it is while files of the sources change.
    """
    std = names.standard_name
    map_add = [std] if map_add is None else map_add
    us_add = [names.us_segment] if us_add is None else us_add
    ww_add = [names.ww_segment] if ww_add is None else ww_add
    if std not in map_add:
        raise ValueError(f"the map must add {std!r}, by which the segments are found")
    if broadcast_bytes is not None:
        tables = (sponsor_map, us_segments, ww_segments)
        sponsor_map, us_segments, ww_segments = broadcast_small(*tables, max_bytes=broadcast_bytes)
    if cleanse:
        sponsor_map, us_segments, ww_segments = (
            clean_lookup(t, title_case=title_case, punct=punct, numbers=numbers)
            for t in (sponsor_map, us_segments, ww_segments)
        )
    segments = ((us_segments, us_add, us_key or std), (ww_segments, ww_add, ww_key or std))

    def with_segments(rows: DataFrame) -> DataFrame:
        for table, add, name in segments:
            rows = _append(rows, col(_NEXT), table, _key_of(table, name, mode), add)
        return rows

    right_key = map_right_key or names.lead_sponsor
    key, next_key = _key_of(sponsor_map, right_key, mode).alias(_MAPKEY), norm_key(col(std), mode=mode).alias(_NEXT)
    small = with_segments(sponsor_map.select(key, *[col(n) for n in map_add], next_key))
    small = small.drop(_NEXT).withColumn(_HIT, F.lit(True))
    # Cleaned tables hold no NULL, so a trial without a standard name meets nothing.
    none = None
    if not cleanse:
        none = with_segments(sponsor_map.sparkSession.range(1).select(F.lit(None).cast("string").alias(_NEXT)))
    if root is not None:
        small = _fixed(small, f"{root}/chain")
        none = none if none is None else _fixed(none, f"{root}/unmatched")
    if broadcast_bytes is not None:  # repeated keys multiply, so the result has its own size
        small, *rest = broadcast_small(*[t for t in (small, none) if t is not None], max_bytes=broadcast_bytes)
        none = rest[0] if rest else None
    return PreparedChain(
        map_left_key or names.lead_sponsor,
        mode,
        (*map_add, *us_add, *ww_add),
        tuple(add[0] for _, add, _ in segments if add),
        small,
        none,
    )


def _fixed(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_chain(
    df: DataFrame,
    sponsor_map: DataFrame,
    us_segments: DataFrame,
    ww_segments: DataFrame,
    *,
    names: Names = Names(),
    map_add: list[str] | None = None,
    **options: object,
) -> DataFrame:
    """Lead sponsor to standard name, standard name to US and to WW segment.

    The key of the second and third lookup depends on the first lookup's row alone, so the three
    tables are joined with each other first, and ``df`` with the result once. NULL meets NULL:
    where tables are not cleaned, a trial without a standard name gets the segments of a NULL
    name, from a second table that is as small. Keys are the lead sponsor and the standard name
    unless named; ``punct`` concerns the cleaning alone. The first appended column of each segment
    table gets the default. With ``broadcast_bytes``, tables are measured by ``broadcast_small``;
    without, the optimizer chooses. A map that does not add the standard name leaves it to ``df``,
    and the tables are joined one by one.
    """
    if map_add is None or names.standard_name in map_add:
        return prepare_chain(sponsor_map, us_segments, ww_segments, names=names, map_add=map_add, **options).append(df)
    return _one_by_one(df, (sponsor_map, us_segments, ww_segments), names, map_add, **options)


def _one_by_one(
    df: DataFrame,
    tables: tuple[DataFrame, DataFrame, DataFrame],
    names: Names,
    map_add: list[str],
    *,
    map_left_key: str | None = None,
    map_right_key: str | None = None,
    us_key: str | None = None,
    ww_key: str | None = None,
    us_add: list[str] | None = None,
    ww_add: list[str] | None = None,
    cleanse: bool = True,
    title_case: bool = True,
    punct: bool = True,
    numbers: Iterable[str] = (),
    mode: str = "compat",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    if broadcast_bytes is not None:
        tables = tuple(broadcast_small(*tables, max_bytes=broadcast_bytes))
    if cleanse:
        tables = tuple(clean_lookup(t, title_case=title_case, punct=punct, numbers=numbers) for t in tables)
    sponsor_map, us_segments, ww_segments = tables
    left_key, right_key = map_left_key or names.lead_sponsor, map_right_key or names.lead_sponsor
    out = _append(df, _key_of(df, left_key, mode), sponsor_map, _key_of(sponsor_map, right_key, mode), map_add)
    out = out.withColumn(_NEXT, _key_of(out, names.standard_name, mode))
    us_add = [names.us_segment] if us_add is None else us_add
    ww_add = [names.ww_segment] if ww_add is None else ww_add
    for table, add, key in ((us_segments, us_add, us_key), (ww_segments, ww_add, ww_key)):
        out = _append(out, col(_NEXT), table, _key_of(table, key or names.standard_name, mode), add)
    out = out.drop(_NEXT)
    for add in (us_add, ww_add):
        if add:
            out = fill_default(out, add[0])
    return out
