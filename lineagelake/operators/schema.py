"""Stage contracts: which columns of which kind a stage reads and writes. Checks look at the schema only; no job runs."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = {
    "i": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "f": (T.FloatType, T.DoubleType),
    "b": (T.BooleanType,),
    "s": (T.StringType,),
}
#: Columns of the stages and their kinds: fixed values of the data model.
PEDIGREE = {
    "id": "i", "generation": "i", "sex": "i", "mother": "i", "father": "i", "twin": "i", "household_id": "i",
    "A1": "f", "C1": "f", "E1": "f", "liability1": "f", "A2": "f", "C2": "f", "E2": "f", "liability2": "f",
}
PHENOTYPE = {**PEDIGREE, "t1": "f", "t2": "f"}
CENSORED = {
    **PHENOTYPE, "death_age": "f",
    "age_censored1": "b", "t_observed1": "f", "death_censored1": "b", "affected1": "b",
    "age_censored2": "b", "t_observed2": "f", "death_censored2": "b", "affected2": "b",
}


def assert_schema(df: DataFrame, contract: dict[str, str], where: str = "") -> DataFrame:
    """Raises ValueError for missing columns or wrong kinds; further columns are allowed."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in contract if c not in types]
    if missing:
        raise ValueError(f"{where or 'schema'}: missing columns {missing}")
    wrong = {c: types[c].simpleString() for c, kinds in contract.items() if not isinstance(types[c], tuple(t for k in kinds for t in KINDS[k]))}
    if wrong:
        raise ValueError(f"{where or 'schema'}: wrong types {wrong}")
    return df


def stage(*, reads: dict[str, str] | None = None, writes: dict[str, str] | None = None, name: str | None = None) -> Callable:
    """Checks the first argument against `reads`, runs, and checks the result against `writes`."""

    def wrap(fn: Callable) -> Callable:
        title = name or fn.__name__
        first = next(iter(inspect.signature(fn).parameters), None)

        @functools.wraps(fn)
        def run(*args, **kwargs):
            if reads:
                assert_schema(args[0] if args else kwargs[first], reads, f"{title} input")
            out = fn(*args, **kwargs)
            return assert_schema(out, writes, f"{title} output") if writes else out

        run.reads, run.writes, run.stage_name = reads, writes, title
        return run

    return wrap
