"""Readers and writers of the formats that annotation corpora come in.

A bad row or file never ends a job: readers that parse give an ``error`` column, null for
good rows.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = (
    "array<struct<text:string,type:string,start:int,`end`:int,position:array<int>,"
    "assertions:array<string>,candidates:array<string>,confidence:double,source:string>>"
)


def _number(path) -> object:
    return F.regexp_extract(path, r"(\d+)\.[A-Za-z]+$", 1).try_cast("bigint")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of files named by a number; line ends stay as they are."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return raw.select(_number(F.col("path")).alias("doc_id"), F.decode("content", "UTF-8").alias("text")).where("doc_id is not null")


def _spans(df: DataFrame) -> DataFrame:
    e = df.select("record_id", F.posexplode_outer("entities").alias("ord", "e"), "error")
    place = lambda name, i: F.coalesce(F.col(f"e.{name}"), F.get("e.position", F.lit(i)))
    return e.select(
        "record_id", "ord", "e.text", "e.type", place("start", 0).alias("start"), place("end", 1).alias("end"),
        F.array_distinct("e.assertions").alias("assertions"), F.array_distinct("e.candidates").alias("candidates"), "e.confidence", "e.source", "error",
    )


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Spans of JSON files that hold a list of entities each; a file that can't be read gives one row with its error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    body = F.decode("content", "UTF-8")
    d = raw.select(_number(F.col("path")).alias("record_id"), F.from_json(body, ENTITY).alias("entities"), body.alias("body"))
    bad = F.col("entities").isNull() | F.col("record_id").isNull()
    return _spans(d.withColumn("error", F.when(bad, F.lit("not a list of entities in a numbered file")))).where("ord is not null or error is not null")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The same from the numbered JSON members of ZIP files; a member that comes twice is an error."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [i.filename for i in z.infolist()]
                        for n in names:
                            stem = Path(n).stem
                            if n.endswith(".json") and stem.isdigit():
                                rows.append((int(stem), z.read(n).decode("utf-8", "replace"), "member comes twice" if names.count(n) > 1 else None))
                except zipfile.BadZipFile:
                    rows.append((None, None, "not a ZIP file"))
            yield pd.DataFrame(rows, columns=["record_id", "body", "error"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "record_id bigint, body string, error string")
    d = raw.withColumn("entities", F.from_json("body", ENTITY))
    d = d.withColumn("error", F.coalesce("error", F.when(F.col("entities").isNull(), F.lit("not a list of entities"))))
    return _spans(d)


def read_jsonl(spark: SparkSession, path: str, schema: str, reviewed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and what stops their use: ids (``record_id``) that come more than once, with ``n``, and, if ``reviewed`` names
    a column, rows where it isn't true (``reason`` says which). Callers go on if the second table is empty."""
    df = spark.read.schema(schema).json(path)
    stops = df.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").withColumn("reason", F.lit("repeated id"))
    if reviewed:
        open_ = df.where(~F.coalesce(F.col(reviewed), F.lit(False))).groupBy("record_id").agg(F.count("*").alias("n")).withColumn("reason", F.lit("not reviewed"))
        stops = stops.unionByName(open_)
    return df, stops


def subset(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``record_id`` is listed; a listed id may repeat."""
    return df.join(ids.select("record_id").dropna().distinct(), "record_id", "left_semi")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated concept names (18 fields and a last bar), the English ones: identifier, vocabulary, tty, code, name, and ``line``, which grows with the file."""
    raw = spark.read.option("sep", "|").option("quote", "").schema(", ".join(f"_c{i} string" for i in range(19))).csv(path)
    return raw.where("_c1 = 'ENG'").select(F.col("_c0").alias("identifier"), F.col("_c11").alias("vocabulary"), F.col("_c12").alias("tty"), F.col("_c13").alias("code"), F.col("_c14").alias("name"), F.monotonically_increasing_id().alias("line"))


def concept_aliases(concepts: DataFrame, order: list[str]) -> DataFrame:
    """Per folded name the concept of the most preferred type, of those the first line (the least identifier where lines aren't known); types not listed come last."""
    tie = ["line", "identifier"] if "line" in concepts.columns else ["identifier"]
    return concepts.where("name is not null").groupBy(_norm().alias("norm")).agg(F.min(F.struct(_rank(order).alias("rank"), *tie, "tty", "name")).alias("x")).select("norm", "x.identifier", "x.tty", "x.name")


def _norm() -> Column:
    return F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))


def _rank(order: list[str]) -> Column:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("tty")), F.lit(0))
    return F.when(rank == 0, F.lit(len(order) + 1)).otherwise(rank)


def concept_products(concepts: DataFrame, types: list[str]) -> DataFrame:
    """``product, tty, name, norm`` of each identifier and type among ``types``: the last line."""
    own = concepts.where(F.col("tty").isin(*types) & F.col("name").isNotNull()).withColumn("norm", _norm())
    return own.groupBy(F.col("identifier").alias("product"), "tty").agg(F.max(F.struct("line", "name", "norm")).alias("x")).select("product", "tty", "x.name", "x.norm")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated relations (16 fields and a last bar): first and second concept, relation, vocabulary, line."""
    raw = spark.read.option("sep", "|").option("quote", "").schema(", ".join(f"_c{i} string" for i in range(17))).csv(path)
    return raw.select(F.col("_c0").alias("first"), F.col("_c4").alias("second"), F.col("_c7").alias("relation"), F.col("_c10").alias("vocabulary"), F.monotonically_increasing_id().alias("line"))


def brand_generics(relations: DataFrame, concepts: DataFrame, order: list[str]) -> DataFrame:
    """``code, generic``: the folded name of each brand's generic, by the last relation that names one.

    Of ``tradename_of`` the second concept is the brand, of ``has_tradename`` the first, as the table has them. A generic goes by its name of the most preferred
    type in ``order``, the first line of those; brands of a generic without one are out.
    """
    named = F.col("relation") == "tradename_of"
    r = relations.where(F.col("relation").isin("tradename_of", "has_tradename"))
    r = r.select(F.when(named, F.col("second")).otherwise(F.col("first")).alias("code"), F.when(named, F.col("first")).otherwise(F.col("second")).alias("identifier"), "line").dropna()
    last = r.groupBy("code").agg(F.max_by("identifier", "line").alias("identifier"))
    own = concepts.where(F.col("tty").isin(*order) & F.col("name").isNotNull()).withColumn("norm", _norm())
    name = own.groupBy("identifier").agg(F.min(F.struct(_rank(order).alias("rank"), "line", "norm")).alias("x")).select("identifier", F.col("x.norm").alias("generic"))
    return last.join(name, "identifier").select("code", "generic")


def ingredient_index(concepts: DataFrame, ingredients: list[str]) -> DataFrame:
    """``ingredient, strength, code``: concepts whose name holds a listed ingredient (anywhere in it), by each strength the name states; empty if it states none.

    The list goes to each worker; names meet it in one reading each.
    """
    listed = tuple(sorted({i.casefold() for i in ingredients if i}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for i in listed:
            auto.add_word(i, i)
        auto.make_automaton()
        for pdf in batches:
            rows = []
            for code, name in zip(pdf["identifier"], pdf["name"]):
                term = name.casefold()
                found = {i for _, i in auto.iter(term)} if listed else set()
                rows += [(i, s, code) for i in sorted(found) for s in sorted(set(re.findall(r"\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml)", term))) or [""]]
            yield pd.DataFrame(rows, columns=["ingredient", "strength", "code"])

    return concepts.where("identifier is not null and name is not null").select("identifier", "name").mapInPandas(run, "ingredient string, strength string, code string").distinct()


def strengths(concepts: DataFrame) -> DataFrame:
    """Each strength that a name states: identifier and the number with its unit in one spelling."""
    found = F.regexp_extract_all(F.lower("name"), F.lit(r"(\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|%|unt)(?:/ml)?)"), F.lit(1))
    return concepts.select("identifier", F.explode(found).alias("strength")).select("identifier", F.regexp_replace("strength", r"\s+", " ").alias("strength")).distinct()


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated classification (nine fields or more): code in field 8, title in field 9; others are out. Of repeated codes the last line counts."""
    parts = F.split("value", ";", -1)
    d = spark.read.text(path).select(parts.alias("p"), F.monotonically_increasing_id().alias("line")).where(F.size("p") >= 9)
    out = d.select("line", F.trim(F.get("p", F.lit(7))).alias("code"), F.trim(F.get("p", F.lit(8))).alias("title"))
    return out.where(F.col("code").rlike(r"^[A-Z]\d\d(\.[0-9A-Z]+)?$")).groupBy("code").agg(F.max_by("title", "line").alias("title"))


def read_code_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a code, blanks and its title."""
    d = spark.read.text(path).where(F.trim("value") != "")
    return d.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("code"), F.regexp_extract("value", r"^\s*\S+\s+(.*\S)", 1).alias("title"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """Spans of token-and-tag lines: sentences between blank lines, tokens joined by a blank, B-/I- tags merged.

    ``sentence, text, start, end, type``; a sentence without spans comes once with nulls.
    """
    raw = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n\s*\r?\n").alias("s"))
    s = raw.select(F.posexplode("s").alias("sentence", "body")).where(F.trim("body") != "")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, body in zip(pdf["sentence"], pdf["body"]):
                pairs = [x.split() for x in body.splitlines() if x.strip()]
                text = " ".join(p[0] for p in pairs)
                at, spans = 0, []
                for p in pairs:
                    word, tag = p[0], p[-1] if len(p) > 1 else "O"
                    kind = tag[2:] if tag[:2] in ("B-", "I-") else None
                    if kind and tag[0] == "I" and spans and spans[-1][2] == kind and spans[-1][1] == at - 1:
                        spans[-1][1] = at + len(word)
                    elif kind:
                        spans.append([at, at + len(word), kind])
                    at += len(word) + 1
                rows += [(n, text, *x) for x in spans or [(None, None, None)]]
            yield pd.DataFrame(rows, columns=["sentence", "text", "start", "end", "type"]).astype({"start": "Int32", "end": "Int32"})

    return s.mapInPandas(parse, "sentence int, text string, start int, `end` int, type string")


def to_entity_json(spans: DataFrame, coded: tuple[str, ...] = ("CHẨN_ĐOÁN", "THUỐC")) -> DataFrame:
    """``record_id, json``: per record the list of its entities by position, codes on coded types only."""
    flat = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))
    s = spans.dropna(subset=["record_id", "start", "end", "type"])
    e = F.struct(
        F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("type").alias("_t"),
        F.struct("text", "type", F.array("start", "end").alias("position"), flat(F.col("assertions")).alias("assertions"),
                 F.when(F.col("type").isin(*coded), flat(F.col("candidates"))).alias("candidates")).alias("e"),
    )
    rows = s.groupBy("record_id").agg(F.array_sort(F.collect_list(e)).alias("x"))
    return rows.select("record_id", F.to_json(F.transform("x", lambda y: y["e"])).alias("json"))


def write_entity_json(spans: DataFrame, path: str) -> None:
    """One line a record, partitioned as the table is."""
    to_entity_json(spans).select("json").write.mode("overwrite").text(path)


def write_proposals(proposals: DataFrame, path: str) -> None:
    """Parquet by source, so that readers of one source read no other."""
    proposals.write.mode("overwrite").partitionBy("source").parquet(path)


def package(members: DataFrame, path: str) -> int:
    """A ZIP of ``name, body`` that is the same bytes for the same rows: sorted, one time stamp, one mode. A small sink."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in members.select("name", "body").orderBy("name").toLocalIterator():
            info = zipfile.ZipInfo(r.name, (2020, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16  # a fixed value, as the time above
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, r.body)
            n += 1
    return n


def write_report(report: dict, path: str) -> str:
    """Indented JSON with a digest of its content in one form; gives the digest."""
    import hashlib

    digest = hashlib.sha256(json.dumps(report, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    Path(path).write_text(json.dumps(report | {"content_sha256": digest}, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return digest


def upsert(table: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """The table with later rows of a key in place of earlier ones; on equal times the new rows win."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def model_spans(docs: DataFrame, client) -> DataFrame:
    """Spans that ``client(text) -> list of (start, end, type, confidence)`` gives; failures are in ``error``, three tries each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                error = None
                for _ in range(3):
                    try:
                        rows += [(doc, a, b, k, c, None) for a, b, k, c in client(text)]
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a client raises is the row's error
                        error = str(e)[:200]
                if error is not None:
                    rows.append((doc, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "type", "confidence", "error"]).astype({"start": "Int32", "end": "Int32"})

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, start int, `end` int, type string, confidence double, error string")


def embed_missing(texts: DataFrame, cache: DataFrame, model) -> DataFrame:
    """``key, embedding`` of texts that the cache lacks, by ``model(list of texts) -> list of vectors``; a null text has none."""
    keyed = texts.where("text is not null").select(F.sha2("text", 256).alias("key"), "text").distinct()
    new = keyed.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "embedding": list(model(pdf["text"].tolist()))})

    return new.mapInPandas(run, "key string, embedding array<float>")
