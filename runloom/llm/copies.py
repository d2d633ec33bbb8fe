"""Duplicates hidden by formatting differences: progressive refinement of a partition of the records."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom import scratch
from runloom.operators.shred import read_value

_NOT_WORD = re.compile(r"[\W_]+")


def stripped(text) -> str:
    """The letters and digits of a value in order, case folded; '' for null."""
    if text is None:
        return ""
    text = str(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _NOT_WORD.sub("", text.casefold())


def _several(members: DataFrame, key: list[str]) -> DataFrame:
    """The members that share key with another. Classes are counted before they are joined, and those of one member
    are gone by then; a class with very many members only makes a join partition large, which adaptive execution splits."""
    return members.join(members.groupBy(*key).count().where("count > 1").drop("count"), key)


def hidden_copies(records: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """(record_id, first_id, copies): every record with the least id of its class and the number of members.

    Two records are copies if each of the fields, taken in their given order, has the same letters and digits in the
    same order; case, white space, punctuation and other signs are left out. Null and empty fields are alike. Records
    whose fields are all null are in no class with others. record_id must be a unique integer.

    The partition is refined step by step: by stripped lengths, then by the letter histogram (the sorted letters), then
    by a 192-bit digest of the stripped text; each key is made only for records that still share a class with another.
    """
    names = [f"f{i}" for i in range(len(fields))]
    known = F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()
    base = records.select(F.col(record_id).cast("long").alias("record_id"), known.alias("known"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)])

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n in names:
                b[n] = [stripped(x) for x in b[n]]
            yield b

    base = scratch.table(base.mapInPandas(strip, base.schema), "stripped")
    lengths = [F.length(n).alias(f"l{n}") for n in names]
    text = F.concat_ws("\x01", *names)
    one = _several(base.where("known").select("record_id", *lengths), [f"l{n}" for n in names]).select("record_id")
    two = base.join(one, "record_id", "left_semi").select("record_id", F.struct(*lengths).alias("lengths"), F.xxhash64(F.array_sort(F.split(text, ""))).alias("histogram"))
    two = scratch.table(_several(two, ["lengths", "histogram"]).select("record_id", "lengths", "histogram"), "letters")
    three = base.join(two, "record_id").select("record_id", "lengths", "histogram", F.struct(F.md5(text).alias("a"), F.xxhash64(text).alias("b")).alias("digest"))
    three = scratch.table(three, "digests")
    key = ["lengths", "histogram", "digest"]
    classes = three.groupBy(*key).agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = three.join(classes, key).select("record_id", "first_id", "copies")
    out = base.select("record_id").join(found, "record_id", "left")
    return out.select("record_id", F.coalesce("first_id", "record_id").alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def prediction_fields(preds: DataFrame) -> DataFrame:
    """(pred_id, instance_id, model_name_or_path, model_patch) of pred_json, whole JSON or Python literals alike.

    A record with several instances gives their fields joined in order of the instances' stripped names. Field names
    are matched exactly. What can't be read has null fields.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, body in zip(b["pred_id"], b["pred_json"]):
                value = read_value(body) if body is not None else None
                inner = [x for x in value.values() if isinstance(x, dict)] if isinstance(value, dict) else []
                if isinstance(value, dict) and "model_patch" in value:
                    inner = [value]
                inner.sort(key=lambda x: stripped(x.get("instance_id")))
                if not inner:
                    rows.append((rid, None, None, None))
                    continue
                rows.append((rid, *["\n".join("" if x.get(f) is None else str(x[f]) for x in inner) for f in ("instance_id", "model_name_or_path", "model_patch")]))
            yield pd.DataFrame(rows, columns=["pred_id", "instance_id", "model_name_or_path", "model_patch"])

    return preds.where("pred_id is not null").select("pred_id", "pred_json").mapInPandas(read, "pred_id long, instance_id string, model_name_or_path string, model_patch string")


def prediction_copies(preds: DataFrame) -> DataFrame:
    return hidden_copies(prediction_fields(preds), "pred_id", ["instance_id", "model_name_or_path", "model_patch"]).withColumnRenamed("record_id", "pred_id")
