"""Readers of text formats: treebanks, counted groups, statements, book files, framed records, file selection."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def select_paths(paths: Iterable[str], ignore: str = "", prefer: Iterable[tuple[str, str]] = (), keep: Iterable[str] = ("*",), drop: Iterable[str] = ()) -> list[str]:
    """Paths a source reads: no hidden names; patterns of an ignore file (last match wins, ! re-admits, a trailing /
    means a folder); the preferred of two siblings; keep and drop globs."""
    rules = [x.strip() for x in ignore.splitlines() if x.strip() and not x.startswith("#")]

    def ignored(path: str) -> bool:
        out = False
        pieces = path.split("/")
        for rule in rules:
            negated, rule_ = rule.startswith("!"), rule.lstrip("!")
            folder, body = rule_.endswith("/"), rule_.strip("/")
            if "/" in body:
                hit = fnmatch.fnmatch(path, body) or path.startswith(body + "/")
            else:
                names = pieces[:-1] if folder else pieces
                hit = any(fnmatch.fnmatch(n, body) for n in names)
            if hit:
                out = not negated
        return out

    found = [p for p in paths if not any(n.startswith(".") for n in p.split("/")) and not ignored(p)]
    found = [p for p in found if any(fnmatch.fnmatch(p, k) for k in keep) and not any(fnmatch.fnmatch(p, d) for d in drop)]
    for better, worse in prefer:
        have = {p.rpartition("/")[0] for p in found if fnmatch.fnmatch(p.rpartition("/")[2], better)}
        found = [p for p in found if not (fnmatch.fnmatch(p.rpartition("/")[2], worse) and p.rpartition("/")[0] in have)]
    return sorted(found)


def choose_recipe(path: str, head: str, globs: dict[str, str], interpreters: dict[str, str]) -> str | None:
    """Recipe of a file: by name, else by its #! line, else JSON or XML by its first character."""
    name = path.rpartition("/")[2]
    for pattern, recipe in globs.items():
        if fnmatch.fnmatch(name, pattern):
            return recipe
    if m := re.match(r"#!\s*(\S+)(?:[ \t]+(\S+))?", head):
        command = m[1].rpartition("/")[2]
        command = m[2] if command == "env" and m[2] else command
        return interpreters.get(command)
    return {"{": "json", "[": "json", "<": "xml"}.get(head.lstrip()[:1])


def statements(lines: DataFrame) -> DataFrame:
    """subject TAB relation TAB object TAB score; a backslash keeps a tab or a backslash inside a part. A line without
    subject or relation, or with a score that is no number from 0 to 1, refuses the input. lines(value)"""
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace("value", r"\\\\", "\u0001"), r"\\\t", "\u0002"), "\t"), lambda c: F.translate(c, "\u0001\u0002", "\\\t"))
    rows = lines.select(cells.alias("c"))
    get = lambda i: F.nullif(F.get("c", F.lit(i)), F.lit(""))
    written = get(3)
    number = written.try_cast("double")
    bad = get(0).isNull() | get(1).isNull() | (written.isNotNull() & ~F.coalesce(number.between(0, 1), F.lit(False))) | (F.size("c") > 4)
    ok = rows.withColumn("subject", F.when(bad, F.raise_error(F.concat(F.lit("not a statement: "), F.array_join("c", "|")))).otherwise(get(0)))
    return ok.select("subject", get(1).alias("relation"), get(2).alias("object"), F.coalesce(number, F.lit(1.0)).alias("score"))


def treebank(texts: DataFrame) -> DataFrame:
    """CoNLL-U: one row per sentence with aligned layers, and the head pointers of its tree. texts(value): whole files."""
    blocks = texts.select(F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), r"\n[ \t]*\n")).alias("sentence", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^\d+\t"))
    rows = blocks.select("sentence", F.regexp_extract("block", r"(?m)^# text = (.*)$", 1).alias("text"), F.transform(lines, lambda x: F.split(x, "\t")).alias("t")).filter(F.size("t") > 0)
    column = lambda k: F.transform("t", lambda x: F.get(x, F.lit(k)))
    names = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel")
    return rows.select("sentence", "text", *[column(i).alias(n) for i, n in enumerate(names)])


def tree_edges(sentences: DataFrame) -> DataFrame:
    """(sentence, head, relation, dependent, ordinal) from treebank()."""
    z = F.arrays_zip("id", "form", "head", "deprel")
    rows = sentences.select("sentence", "id", "form", F.posexplode(z).alias("ordinal", "x"))
    at = F.array_position("id", F.col("x.head"))
    return rows.select("sentence", F.when(at > 0, F.get("form", at.cast("int") - 1)).alias("head"), F.col("x.deprel").alias("relation"), F.col("x.form").alias("dependent"), "ordinal")


def surface(forms: Column, glued: Column) -> Column:
    """Text of aligned rows: a space after each form unless its row says it is glued to the next."""
    return F.rtrim(F.array_join(F.zip_with(forms, glued, lambda f, g: F.when(F.coalesce(g, F.lit(False)), f).otherwise(F.concat(f, F.lit(" ")))), ""))


def counted_groups(lines: DataFrame) -> DataFrame:
    """WordNet data lines: offset, kind, words (counted in hex), pointers (counted), gloss. Lines that open with a space
    are remarks. lines(value)"""
    rows = lines.filter(~F.col("value").startswith(" ")).select(F.split(F.trim(F.substring_index("value", " | ", 1)), " +").alias("t"), F.trim(F.element_at(F.split("value", r" \| "), -1)).alias("gloss"))
    n = F.conv(F.get("t", F.lit(3)), 16, 10).cast("int")
    rows = rows.withColumn("n", n).withColumn("p", F.get("t", F.lit(4) + 2 * F.col("n")).cast("int"))
    word = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("t", F.lit(4) + i * 2))
    base = F.lit(5) + 2 * F.col("n")
    pointer = F.when(
        F.col("p") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("p") - 1),
            lambda i: F.struct(F.get("t", base + i * 4).alias("symbol"), F.get("t", base + i * 4 + 1).alias("target"), F.get("t", base + i * 4 + 2).alias("pos"), F.get("t", base + i * 4 + 3).alias("between")),
        ),
    ).otherwise(F.array().cast("array<struct<symbol:string,target:string,pos:string,between:string>>"))
    return rows.select(F.get("t", F.lit(0)).alias("offset"), F.get("t", F.lit(2)).alias("kind"), word.alias("words"), pointer.alias("pointers"), "gloss")


def book(texts: DataFrame) -> DataFrame:
    """Project book files: title, author and language from the header, and the body between the start and end marks.
    texts(value): whole files."""
    start = r"(?is)^.*?\*\*\* ?START OF TH(?:E|IS) [^\n*]*\*\*\*\s*\n"
    stop = r"(?is)\n\s*\*\*\* ?END OF TH(?:E|IS) .*$"
    head = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    return texts.select(head("Title").alias("title"), head("Author").alias("author"), head("Language").alias("language"), F.trim(F.regexp_replace(F.regexp_replace("value", start, ""), stop, "")).alias("body"))


def turtle(texts: DataFrame) -> DataFrame:
    """Subject blocks of a Turtle file as (subject, predicate, object, language). texts(value): whole files."""
    clean = F.regexp_replace("value", r"(?m)^\s*(#|@prefix|PREFIX|@base|BASE).*$", "")
    blocks = texts.select(F.explode(F.regexp_extract_all(clean, F.lit(r'((?:"(?:[^"\\]|\\.)*"|<[^>]*>|[^."<]|\.(?=\S))+)\s*\.(?=\s|$)'), 1)).alias("b"))
    tokens = F.regexp_extract_all(F.trim("b"), F.lit(r'("(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|<[^>]*>|[;,]|[^\s;,]+)'), 1)
    rows = blocks.select(tokens.alias("t")).filter(F.size("t") >= 3)
    rows = rows.select(F.get("t", F.lit(0)).alias("subject"), F.explode(F.split(F.array_join(F.slice("t", F.lit(2), F.size("t")), "\u0001"), "\u0001;\u0001?")).alias("po")).filter("po <> ''")
    rows = rows.select("subject", F.substring_index("po", "\u0001", 1).alias("predicate"), F.explode(F.split(F.expr("substring(po, locate('\u0001', po) + 1)"), "\u0001,\u0001")).alias("o"))
    language = F.nullif(F.regexp_extract("o", r'"@([\w-]+)$', 1), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace("o", r'^"(.*)"(?:@[\w-]+|\^\^\S+)?$', "$1"), r'\\(["\\])', "$1")
    return rows.select(F.translate("subject", "<>", "").alias("subject"), F.translate("predicate", "<>", "").alias("predicate"), F.when(F.col("o").startswith('"'), plain).otherwise(F.translate("o", "<>", "")).alias("object"), language.alias("language"))


def framed(spark: SparkSession, path: str, width: int = 4, big: bool = False) -> DataFrame:
    """Length-prefixed records of binary files: (file, ordinal, payload). A frame that is cut off refuses the file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                at, n = 0, 0
                while at < len(content):
                    size = int.from_bytes(content[at : at + width], "big" if big else "little")
                    if at + width + size > len(content):
                        raise ValueError(f"{name}: a frame is cut off")
                    out.append((name, n, content[at + width : at + width + size]))
                    at, n = at + width + size, n + 1
            yield pd.DataFrame(out, columns=["file", "ordinal", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, ordinal int, payload binary")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab separated text; tabs, line ends and backslashes inside a cell are written after a backslash."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n")
    rows.select(F.concat_ws("\t", *[cell(c) for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)
