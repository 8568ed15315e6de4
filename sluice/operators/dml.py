"""Data modification as pure functions from table state to table state, and constraint checks as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintViolation(Exception):
    """SQLSTATE and what broke it."""

    def __init__(self, state: str, message: str):
        super().__init__(f"{state}: {message}")
        self.state = state


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """UPDATE: rows for which ``where`` is true get the values; types stay."""
    on = F.coalesce(where, F.lit(False))
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(*[F.when(on, lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows for which ``where`` is true go."""
    return df.where(~F.coalesce(where, F.lit(False)))


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: source rows whose key is new; of source rows that share one, one."""
    new = source.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return target.unionByName(new.select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], set_: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE. In ``set_`` and ``where``, t.<c> is the row that is there and excluded.<c> the new one; by default all other columns take the new values."""
    return merge(target, source, keys, {c: F.col(f"excluded.{c}") for c in target.columns if c not in keys} if set_ is None else set_, where, "excluded")


def merge(target: DataFrame, source: DataFrame, keys: list[str], matched: dict[str, Column], where: Column | None = None, alias: str = "s", insert: bool = True) -> DataFrame:
    """MERGE: one full outer join on the keys. Source keys should be unique; a null key never matches, so its row is inserted."""
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias(alias)
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"t.{k}") == F.col(f"{alias}.{k}"))
    j = t.join(s, on, "full" if insert else "left")
    hit = F.col("t._t").isNotNull() & F.col(f"{alias}._s").isNotNull() & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    out = []
    for c in target.columns:
        kept = F.col(f"t.{c}")
        new = F.when(hit, matched[c].cast(target.schema[c].dataType)).otherwise(kept) if c in matched else kept
        fresh = F.col(f"{alias}.{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        out.append(F.when(F.col("t._t").isNull(), fresh).otherwise(new).alias(c))
    return j.select(*out)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """UNIQUE and primary key violations: keys (none null) that more than one row has."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """CHECK violations: rows for which the condition is false; unknown passes."""
    return df.where(~F.coalesce(condition, F.lit(True)))


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(" OR ".join(f"`{c}` IS NULL" for c in cols))


def orphans(child: DataFrame, parent: DataFrame, fk: dict[str, str], pending: DataFrame | None = None) -> DataFrame:
    """Foreign key violations: rows whose key, if no part of it is null, no parent row has. ``pending``: parent rows of the same statement."""
    keys = parent.select(*[F.col(p).alias(f"_{p}") for p in fk.values()])
    if pending is not None:
        keys = keys.union(pending.select(*fk.values()))
    on = F.lit(True)
    for c, p in fk.items():
        on = on & (F.col(c) == F.col(f"_{p}"))
    return child.dropna(subset=list(fk)).join(keys, on, "left_anti")


def delete_parent(parent: DataFrame, where: Column, children: list[tuple[DataFrame, dict[str, str], str]]) -> tuple[DataFrame, list[DataFrame]]:
    """DELETE on a parent with its children's rules: RESTRICT fails if a child refers to a row that goes, CASCADE deletes with it, SET NULL unties."""
    gone = parent.where(F.coalesce(where, F.lit(False)))
    out = []
    for child, fk, rule in children:
        keys = gone.select(*[F.col(p).alias(f"_{p}") for p in fk.values()]).distinct()
        on = F.lit(True)
        for c, p in fk.items():
            on = on & (F.col(c) == F.col(f"_{p}"))
        if rule == "RESTRICT":
            if not child.join(keys, on, "left_semi").isEmpty():
                raise ConstraintViolation("23503", f"rows refer to what is deleted by {list(fk)}")
            out.append(child)
        elif rule == "CASCADE":
            out.append(child.join(keys, on, "left_anti"))
        else:
            tied = child.join(keys.withColumn("_hit", F.lit(True)), on, "left")
            out.append(tied.select(*[F.when(F.col("_hit"), F.lit(None)).otherwise(child[c]).cast(child.schema[c].dataType).alias(c) if c in fk else child[c] for c in child.columns]))
    return delete(parent, where), out


def cascade_key_update(child: DataFrame, moved: DataFrame, fk: str, old: str, new: str) -> DataFrame:
    """ON UPDATE CASCADE: children follow a parent key that changes; ``moved`` maps old to new."""
    m = moved.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return child.join(m, child[fk] == F.col("_old"), "left").select(*[F.coalesce("_new", child[c]).alias(c) if c == fk else child[c] for c in child.columns])


def enforce(df: DataFrame, state: str, message: str) -> None:
    """Raises if there is any violation."""
    if not df.isEmpty():
        raise ConstraintViolation(state, message)
