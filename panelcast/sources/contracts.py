"""Contracts of frames: columns, kinds and keys of inputs; exact schemas of outputs. All problems are told at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "text": (T.StringType,),
    "integer": (T.IntegralType,),
    "number": (T.NumericType,),
    "date": (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType),
}


class ContractError(ValueError):
    """A frame breaks its contract; `problems` lists each way in which it does."""

    def __init__(self, name: str, problems: Sequence[str]):
        super().__init__(f"{name}: {'; '.join(problems)}")
        self.problems = list(problems)


@dataclass(frozen=True)
class Contract:
    name: str
    columns: Mapping[str, str]
    keys: Sequence[str] = field(default=())


def check_input(frame: DataFrame, contract: Contract) -> DataFrame:
    """The frame, or a ContractError. Kinds are checked on the schema; nulls in keys in one aggregate over all keys. A column of nulls alone has any kind."""
    types = {f.name: f.dataType for f in frame.schema}
    problems = [f"missing column {c}" for c in contract.columns if c not in types]
    for c, kind in contract.columns.items():
        if c in types and not isinstance(types[c], (*KINDS[kind], T.NullType)):
            problems.append(f"column {c} is {types[c].simpleString()}, not {kind}")
    keys = [k for k in contract.keys if k in types]
    if keys:
        nulls = frame.agg(*(F.count_if(F.col(k).isNull()).alias(k) for k in keys)).first()
        problems += [f"{nulls[k]} null values in key {k}" for k in keys if nulls[k]]
    if problems:
        raise ContractError(contract.name, problems)
    return frame


def same_schema(frame: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """The frame, if it has exactly these columns in this order and of these types. No job runs."""
    have, want = [(f.name, f.dataType) for f in frame.schema], [(f.name, f.dataType) for f in schema]
    if have != want:
        shown = lambda xs: ", ".join(f"{n} {t.simpleString()}" for n, t in xs)
        raise ContractError(name, [f"has ({shown(have)}), wants ({shown(want)})"])
    return frame


def check_output(frame: DataFrame, schema: T.StructType, nullable: Sequence[str] = (), name: str = "output", allowed: Mapping[str, Sequence] | None = None) -> DataFrame:
    """The frame, if it has exactly these columns in this order and of these types, and no nulls but in the nullable ones."""
    same_schema(frame, schema, name)
    strict = [f.name for f in schema if f.name not in nullable]
    tests = {f"{c} has nulls": F.count_if(F.col(c).isNull()) for c in strict}
    tests |= {f"{c} has other values than {', '.join(map(str, v))}": F.count_if(~F.col(c).isin(list(v))) for c, v in (allowed or {}).items()}
    if tests:
        found = frame.agg(*(v.alias(str(k)) for k, v in enumerate(tests.values()))).first()
        problems = [f"{label} ({found[k]} rows)" for k, label in enumerate(tests) if found[k]]
        if problems:
            raise ContractError(name, problems)
    return frame
