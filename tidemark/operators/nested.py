"""Walks over nested JSON of any depth, as variants, one level of all documents at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shards import shared_folder


def _kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that no level is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def walk(docs: DataFrame, ids: list[str], json: str, most: int = 1000) -> DataFrame:
    """Every node below the roots: rows (ids, path, key, text, depth). ``key`` is null for items of an array, ``text`` for all but strings.

    A level is one distributed explode of the containers of the level before; the walk ends when a level has none, or
    fails beyond ``most`` levels. A text that is no JSON fails; null has no nodes. The root itself is a node with the path `$`.
    """
    spark = docs.sparkSession
    kind = F.schema_of_variant(F.col("v"))
    describe = lambda df: df.withColumn("_kind", kind)
    text = F.when(F.col("_kind") == "STRING", F.expr("try_variant_get(v, '$', 'string')"))
    level = describe(docs.select(*ids, F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.parse_json(F.col(json)).alias("v")).where("v is not null"))
    nodes = []
    for depth in range(most + 1):
        level = _kept(level)
        nodes.append(level.select(*ids, "path", "key", text.alias("text"), F.lit(depth).alias("depth")))
        inner = level.where(F.col("_kind").startswith("OBJECT<") | F.col("_kind").startswith("ARRAY<")).select(*ids, F.col("path").alias("_path"), F.col("v").alias("_v"))
        if inner.isEmpty():
            break
        item = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        path = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("_path", F.lit("."), "key"))
        level = describe(item.select(*ids, path.alias("path"), "key", F.col("value").alias("v")))
    else:
        raise ValueError(f"JSON is nested more than {most} levels deep")
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionAll(more)
    return out


def _denials(ids: list[str], words: list[str], key_parts: list[str], text_parts: list[str], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is denied in each document of a batch (ids, text)."""
    whole, seen = frozenset(words), {}

    def bad(text: str, parts: list[str]) -> bool:
        low = text.lower()
        return low in whole or any(p in low for p in parts)

    def bad_key(key: str) -> bool:
        if key not in seen:
            if len(seen) >= 65_536:
                seen.clear()
            seen[key] = bad(key, key_parts)
        return seen[key]

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("a key is there twice in an object of the JSON")
        return out

    def no_number(text: str) -> None:
        raise ValueError(f"{text} is not JSON")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = json.JSONDecoder(object_pairs_hook=once, parse_constant=no_number).decode
        for batch in batches:
            rows, paths, whats = [], [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                level = [] if text is None else [("$", read(text))]
                depth = 0
                while level:
                    if depth > most:
                        raise ValueError(f"JSON is nested more than {most} levels deep")
                    inner = []
                    for path, v in level:
                        if type(v) is str:
                            if bad(v, text_parts):
                                rows.append(k), paths.append(path), whats.append("value")
                        elif type(v) is dict:
                            for key, x in v.items():
                                if bad_key(key):
                                    rows.append(k), paths.append(f"{path}.{key}"), whats.append("key")
                                if type(x) in (str, dict, list):
                                    inner.append((f"{path}.{key}", x))
                        elif type(v) is list:
                            inner += [(f"{path}[{i}]", x) for i, x in enumerate(v) if type(x) in (str, dict, list)]
                    level, depth = inner, depth + 1
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(paths, pa.string()), pa.array(whats, pa.string())], [*ids, "path", "what"])

    return find


def denied(docs: DataFrame, ids: list[str], json: str, words: list[str], key_parts: list[str], text_parts: list[str], most: int = 1000) -> DataFrame:
    """Keys and string values that a deny-list names, at any depth: rows (ids, path, what), ``what`` being 'key' or 'value'.

    ``words`` are whole keys or values, ``key_parts`` and ``text_parts`` parts of them, all in lower case. A document is walked where it lies,
    in one pass: no node is written or shuffled. It fails on a text that is no JSON and beyond ``most`` levels, as ``walk`` does.
    """
    kinds = dict(docs.select(*ids).dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["path string", "what string"])
    return docs.select(*ids, json).mapInArrow(_denials(ids, words, key_parts, text_parts, most), schema)


def require_allowed(docs: DataFrame, ids: list[str], json: str, words: list[str], key_parts: list[str], text_parts: list[str]) -> DataFrame:
    """``docs``; fails at once, with the first path, if the deny-list names anything in them."""
    first = denied(docs, ids, json, words, key_parts, text_parts).orderBy(*ids, "path", "what").limit(1).collect()
    if first:
        raise ValueError(f"forbidden {first[0].what} at {first[0].path} of {[first[0][c] for c in ids]}")
    return docs
