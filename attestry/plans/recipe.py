"""Recipes: a small declarative text that says how rows become claims, compiled to one DataFrame plan.

A line is one declaration. Layout: `name N`, `format tsv|csv|lines`, `header`, `names A B ...`, `quoted C`,
`escaped C`, `comment C`, `empty TEXT`, `part FIELD by SEP|json`. Meaning: `thing NAME...` (the subject),
`content NAME...`, `omit NAME...`, `metadata NAME...`, `attest NAME...`, `pair NAME`, `relate RELATION to NAME [alone]`,
`value NAME as "TEXT"` (the relation's name), `when NAME is|is-not|matches TEXT`, `where ...` (the same for the whole
row), `default NAME TEXT`, `score NAME [from A to B]`, `games NAME`, `strict`, `together NAME`, `qualify NAME`,
`line REGEX` (captures are the parts of a claim), `admit NAME in TABLE.COLUMN`, `refer NAME in TABLE.KEY.VALUE`.

Unknown words are an error; fields of the input that no line mentions are reported, never guessed."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import content_id_of, rescale
from ..operators.keys import admit, resolve


@dataclass
class Recipe:
    name: str = ""
    format: str = "tsv"
    header: bool = False
    names: list[str] = field(default_factory=list)
    quoted: str = ""
    escaped: str = "\\"
    comment: str = ""
    empty: str = ""
    parts: dict[str, str] = field(default_factory=dict)
    thing: list[str] = field(default_factory=list)
    mentioned: set[str] = field(default_factory=set)
    metadata: list[str] = field(default_factory=list)
    statements: list[tuple[str, tuple[str, ...], list[tuple[str, str, str]]]] = field(default_factory=list)
    relation: dict[str, str] = field(default_factory=dict)
    where: list[tuple[str, str, str]] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    score: tuple[str, float, float] | None = None
    games: str | None = None
    strict: bool = False
    together: str | None = None
    qualify: str | None = None
    admits: list[tuple[str, str, str]] = field(default_factory=list)
    refers: list[tuple[str, str, str, str]] = field(default_factory=list)


def parse(text: str) -> Recipe:
    """Read a recipe; `when` belongs to the statement before it."""
    r = Recipe()
    for number, raw in enumerate(text.splitlines(), 1):
        if not raw.strip() or raw.lstrip().startswith("#"):
            continue
        word, *rest = shlex.split(raw, posix=True) if '"' in raw else raw.split()
        try:
            _line(r, word, rest)
        except (ValueError, IndexError) as e:
            raise ValueError(f"line {number}: {raw.strip()!r}: {e}") from e
    return r


def _sep(text: str) -> str:
    return text.encode().decode("unicode_escape")


def _line(r: Recipe, word: str, rest: list[str]) -> None:
    if word in ("name", "format", "quoted", "escaped", "comment", "empty", "games", "together", "qualify"):
        (value,) = rest
        if word == "format" and value not in ("tsv", "csv", "lines"):
            raise ValueError("unknown format")
        setattr(r, word, value)
        if word in ("games", "together", "qualify"):
            r.mentioned.add(value)
    elif word in ("header", "strict"):
        setattr(r, word, True)
    elif word == "names":
        r.names = rest
    elif word == "part":
        name, by, sep = rest
        if by != "by":
            raise ValueError("part NAME by SEP")
        r.parts[name] = "json" if sep == "json" else _sep(sep)
    elif word == "thing":
        r.thing = rest
        r.mentioned |= {*rest}
    elif word in ("content", "omit"):
        r.mentioned |= {*rest}
    elif word == "metadata":
        r.metadata += rest
        r.mentioned |= {*rest}
    elif word == "attest":
        r.mentioned |= {*rest}
        r.statements += [("attest", (n,), []) for n in rest]
    elif word == "pair":
        (n,) = rest
        r.mentioned.add(n)
        r.statements.append(("pair", (n,), []))
    elif word == "relate":
        relation, to, n, *more = rest
        if to != "to" or more not in ([], ["alone"]):
            raise ValueError("relate RELATION to NAME [alone]")
        r.mentioned |= {n} | ({relation} if relation in r.names else set())
        r.statements.append(("relate", (relation, n, *more), []))
    elif word == "line":
        r.statements.append(("line", (" ".join(rest),), []))
    elif word == "value":
        n, as_, text = rest
        if as_ != "as":
            raise ValueError('value NAME as "TEXT"')
        r.relation[n] = text
    elif word in ("when", "where"):
        n, test, *value = rest
        if test not in ("is", "is-not", "matches"):
            raise ValueError("is, is-not or matches")
        r.mentioned.add(n)
        (r.where if word == "where" else r.statements[-1][2]).append((n, test, " ".join(value)))
    elif word == "default":
        n, *value = rest
        r.defaults[n] = " ".join(value)
    elif word == "score":
        n, *scale = rest
        low, high = (float(scale[1]), float(scale[3])) if scale else (0.0, 1.0)
        r.score = n, low, high
        r.mentioned.add(n)
    elif word == "admit":
        n, in_, place = rest
        r.admits.append((n, *place.split(".")))
        r.mentioned.add(n)
    elif word == "refer":
        n, in_, place = rest
        r.refers.append((n, *place.split(".")))
        r.mentioned.add(n)
    else:
        raise ValueError("unknown word")


def read(spark: SparkSession, recipe: Recipe, path: str) -> DataFrame:
    """The rows of a file or folder under the recipe's layout; every field is text."""
    if recipe.format == "lines":
        return spark.read.text(path).withColumnRenamed("value", "line")
    names = recipe.names
    reader = spark.read.option("sep", "\t" if recipe.format == "tsv" else ",").option("header", recipe.header).option("escape", recipe.escaped).option("quote", recipe.quoted or "\0")
    if recipe.comment:
        reader = reader.option("comment", recipe.comment)
    if names:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return reader.option("mode", "PERMISSIVE").csv(path)


def _test(name: str, test: str, value: str) -> Column:
    c = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return {"is": c == value, "is-not": c != value, "matches": c.rlike(value or "$^")}[test]


def _says(default: str):
    return lambda v: v.isNotNull() & (v != "") & (v != F.lit(default))


def _between(subject: Column, relation: Column):
    return lambda v: F.array(subject, relation, v)


def claims(rows: DataFrame, recipe: Recipe, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(record, ordinal, claim, parts, score, run, games, position, qualifier): what the rows attest under the recipe."""
    tables = tables or {}
    if recipe.statements and recipe.statements[0][0] != "line" and not recipe.thing:
        raise ValueError(f"{recipe.name}: no thing is declared")
    for test in recipe.where:
        rows = rows.filter(_test(*test))
    for n, name, key in recipe.admits:
        rows, _ = admit(rows, [n], tables[name], key)
    for n, name, key, value in recipe.refers:
        rows = resolve(rows, n, tables[name], key, value)[0].drop(n).withColumnRenamed("resolved", n)
    columns = set(rows.columns)

    def text(n: str) -> Column:
        c = F.trim(F.col(n).cast("string"))
        return F.nullif(c, F.lit(recipe.empty)) if recipe.empty else F.nullif(c, F.lit(""))

    def values(n: str) -> Column:
        sep = recipe.parts.get(n)
        if sep is None:
            return F.array(text(n))
        if sep == "json":
            return F.coalesce(F.from_json(F.col(n).cast("string"), "array<string>"), F.array(text(n)))
        return F.transform(F.split(F.col(n).cast("string"), re.escape(sep)), F.trim)

    subject = F.concat_ws(" ", *[text(n) for n in recipe.thing]) if recipe.thing else F.lit(None).cast("string")
    none = F.array().cast("array<array<string>>")
    made: list[Column] = []
    for kind, args, tests in recipe.statements:
        ok = F.lit(True)
        for t in tests:
            ok = ok & _test(*t)
        if kind == "line":
            groups = re.compile(args[0]).groups
            parts = F.array(*[F.regexp_extract("line", args[0], g + 1) for g in range(groups)])
            made.append(F.when(ok & F.col("line").rlike(args[0]), F.array(parts)).otherwise(none))
            continue
        n = args[1] if kind == "relate" else args[0]
        got = F.filter(values(n), _says(recipe.defaults.get(n, "\0")))
        if kind == "pair":
            c = F.transform(F.filter(got, lambda v: v != subject), lambda v: F.array(subject, v))
        elif kind == "attest":
            c = F.transform(got, _between(subject, F.lit(recipe.relation.get(n, n))))
        else:
            relation = text(args[0]) if args[0] in columns else F.lit(args[0])
            c = F.transform(got, _between(subject, relation))
            if args[2:] == ("alone",):
                c = F.when(F.size(got) == 0, F.array(F.array(subject, relation))).otherwise(c)
        made.append(F.when(ok, c).otherwise(none))
    score = F.lit(1.0)
    if recipe.score:
        n, low, high = recipe.score
        number = F.col(n).try_cast("double")
        if recipe.strict:
            written = text(n)
            number = F.when(written.isNull() | number.between(low, high), number).otherwise(F.raise_error(F.concat(F.lit("score off its scale: "), written)).cast("double"))
        score = rescale(number, low, high)
    run = F.coalesce(F.col(recipe.games).try_cast("int"), F.lit(1)) if recipe.games else F.lit(1)
    said = F.filter(F.flatten(F.array(*made)), lambda p: F.forall(p, lambda x: x.isNotNull()))
    if recipe.strict:
        said = F.when(F.size(said) > 0, said).otherwise(F.raise_error(F.lit(f"{recipe.name}: a row attests nothing")).cast("array<array<string>>"))
    keep = rows.select(
        F.xxhash64(*rows.columns).alias("record"),
        F.posexplode(said).alias("ordinal", "parts"),
        score.alias("score"),
        run.alias("run"),
        F.lit(bool(recipe.games)).alias("games"),
        (F.col(recipe.together).cast("string") if recipe.together else F.lit(None).cast("string")).alias("unit"),
        (F.col(recipe.qualify).cast("string") if recipe.qualify else F.lit(None).cast("string")).alias("qualifier"),
    )
    out = keep.withColumn("claim", content_id_of("parts"))
    position = F.row_number().over(Window.partitionBy("unit").orderBy("record", "ordinal")) if recipe.together else F.lit(0)
    return out.withColumn("position", position).select("record", "ordinal", "claim", "parts", "score", "run", "games", "position", "qualifier")


def unread(rows: DataFrame, recipe: Recipe) -> list[str]:
    """Fields of the input that the recipe does not mention."""
    return [c for c in rows.columns if c not in recipe.mentioned and c != "line"]


def obligations(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """(field, rows): what was left unread, counted; an ingest refuses if any is left."""
    left = unread(rows, recipe)
    if not left:
        return rows.sparkSession.createDataFrame([], "field string, rows long")
    counts = rows.agg(*[F.count_if(F.col(c).isNotNull()).alias(c) for c in left])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("rows")) for c in left])).alias("x")).select("x.*").filter("rows > 0")
