"""Record predicates, projections from source formats, topic filters, reference resolution and report pages."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def by_server(server: Column, cases: dict[str, Column], default: Column | bool = False) -> Column:
    """The predicate of the record's server."""
    out = default if isinstance(default, Column) else F.lit(default)
    for name, c in cases.items():
        out = F.when(server == name, c).otherwise(out)
    return F.coalesce(out, F.lit(False))


def same_group(authors: Column, group: Column) -> Column:
    return F.coalesce(F.arrays_overlap(authors, group), F.lit(False))


def topics(text: Column, claims: dict[str, list[str]]) -> Column:
    """Names of the claims all of whose patterns match: all claims in one pass over the text, no join."""
    hits = []
    for name, patterns in claims.items():
        every = F.lit(True)
        for p in patterns:
            every = every & text.rlike(p)
        hits.append(F.when(every, name))
    return F.array_compact(F.array(*hits))


def project(rows: DataFrame, body: str, paths: dict[str, str], required: str) -> tuple[DataFrame, Column]:
    """Columns from JSON text by path (null where a part is missing), and whether a row has the required one."""
    cols = {name: F.get_json_object(body, path) for name, path in paths.items()}
    return rows.select("*", *[c.alias(n) for n, c in cols.items()]), F.col(required).isNotNull()


def projected(rows: DataFrame, body: str, server: str) -> DataFrame:
    """id, title, date, authors of records of three layouts, each by its own schema; a row of a wrong kind is left out.
    The union is of filters over one input, so each row's JSON is parsed once, by its own projection."""
    from ..functions import text as T

    others = [c for c in rows.columns if c != body]

    def of(name: str, schema: str, columns: dict[str, Column], wanted: Column) -> DataFrame:
        r = rows.where(F.col(server) == name).select(*others, F.from_json(body, schema).alias("r")).where(wanted)
        return r.select(*others, *[c.alias(n) for n, c in columns.items()])

    r = F.col("r")
    crossref = of(
        "crossref",
        "DOI string, title array<string>, posted struct<`date-parts`: array<array<int>>>, author array<struct<given: string, family: string, name: string>>",
        {
            "id": F.concat(F.lit("doi:"), F.lower(r["DOI"])),
            "title": F.try_element_at(r["title"], F.lit(1)),
            "date": F.date_format(T.date_from_parts(F.try_element_at(r["posted"]["date-parts"], F.lit(1))), "yyyy-MM-dd"),
            "authors": F.transform(r["author"], lambda a: T.author_names(a["given"], a["family"], a["name"])),
        },
        r["DOI"].isNotNull(),
    )
    zenodo = of(
        "zenodo",
        "doi string, metadata struct<title: string, publication_date: string, creators: array<struct<name: string>>, resource_type: struct<type: string>>",
        {"id": F.concat(F.lit("doi:"), F.lower(r["doi"])), "title": r["metadata"]["title"], "date": r["metadata"]["publication_date"], "authors": r["metadata"]["creators"]["name"]},
        r["metadata"]["resource_type"]["type"] == "publication",
    )
    osti = of(
        "osti",
        "osti_id long, title string, publication_date string, authors array<string>",
        {"id": F.concat(F.lit("osti:"), r["osti_id"].cast("string")), "title": r["title"], "date": F.substring(r["publication_date"], 1, 10), "authors": F.transform(r["authors"], T.bare_author)},
        r["osti_id"].isNotNull(),
    )
    return crossref.unionByName(zenodo).unionByName(osti)


def reconcile(slices: DataFrame, expected: str, parsed: str) -> DataFrame:
    """A slice is reconciled if it parsed what was announced and something was."""
    return slices.withColumn("reconciled", (F.col(expected) == F.col(parsed)) & (F.col(expected) > 0))


def age_days(date: Column, run_date: str) -> Column:
    return F.datediff(F.lit(run_date).cast("date"), date)


def resolve(refs: DataFrame, lookups: dict[str, list[DataFrame]]) -> DataFrame:
    """refs (kind, id, title) against the lookups of each kind in turn (id, found_title, status): the first that has the
    id with a status of 200 to 399 answers.  place: which one; verdict: missing, title (another one) or ok; a lookup
    without titles only says that the thing is there."""
    from ..functions.text import title_identity

    parts = []
    for kind, tables in lookups.items():
        known = None
        for place, t in enumerate(tables, 1):
            one = t.where("status BETWEEN 200 AND 399").select("id", F.struct(F.lit(place).alias("place"), "found_title").alias("answer"))
            known = one if known is None else known.unionByName(one)
        first = known.groupBy("id").agg(F.min("answer").alias("answer"))
        j = refs.where(F.col("kind") == kind).join(first, "id", "left").select(*refs.columns, F.col("answer.place").alias("place"), F.col("answer.found_title").alias("found_title"))
        same = F.col("found_title").isNull() | (title_identity(F.col("title")) == title_identity(F.col("found_title")))
        parts.append(j.withColumn("verdict", F.when(F.col("place").isNull(), "missing").when(same, "ok").otherwise("title")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def variant_fields(rows: DataFrame, column: str, fields: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """``rows`` with ``parsed`` (the JSON text is well formed) and, of each field, its value and ``wrong_<field>``.

    fields: name -> (path, type, strict).  The text is parsed once into a variant, whatever its source's shape; a path that
    is missing or null gives null, a value that does not fit the type gives null and is marked wrong.  A strict field
    takes no value of another kind (text that holds a number), the others take what can be cast."""
    held = rows.withColumn("variant_", F.try_parse_json(column))
    out = [F.col(c) for c in rows.columns] + [F.col("variant_").isNotNull().alias("parsed")]
    for name, (path, kind, strict) in fields.items():
        value, there = F.try_variant_get("variant_", path, kind), F.try_variant_get("variant_", path, "variant")
        if strict:
            same = F.schema_of_variant(there).isin("STRING", "BOOLEAN") if kind != "string" else ~F.schema_of_variant(there).eqNullSafe("STRING")
            value = F.when(~same, value)
        present = there.isNotNull() & ~F.is_variant_null(F.coalesce(there, F.parse_json(F.lit("null"))))
        out += [value.alias(name), F.coalesce(present & value.isNull(), F.lit(False)).alias(f"wrong_{name}")]
    return held.select(*out)


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def closing_period(text: Column) -> Column:
    return F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def reference_item(number: Column, title: Column, link: Column) -> Column:
    """A numbered list item that can be linked to."""
    n = number.cast("string")
    return F.concat(F.lit('<li id="ref-'), n, F.lit('">'), closing_period(escape(title)), F.lit(' <a href="'), escape(link), F.lit('">'), escape(link), F.lit("</a></li>"))


def few(rows: DataFrame, limit: int) -> list[Row]:
    """The rows of a result that is meant to be read whole; more than ``limit`` raise, none is left out in silence."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"over {limit} rows of {', '.join(rows.columns)}: too many for one report")
    return found


def report_page(template: str, title: str, tables: dict[str, DataFrame], limit: int = 1000) -> str:
    """The template with {{title}} and {{name}} replaced; tables are small results: more than ``limit`` rows of one raise."""
    page = template.replace("{{title}}", html.escape(title))
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in few(df, limit))
        page = page.replace("{{" + name + "}}", f"<table><tr>{head}</tr>{body}</table>".replace("</script", "<\\/script"))
    return page


def round_floats(rows: DataFrame, digits: int) -> DataFrame:
    """Every floating number rounded, however deep it stands in structs, arrays and maps: a walk over the schema."""
    return rows.select(*[_rounded(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in rows.schema.fields])


def _rounded(c: Column, kind: DataType, digits: int) -> Column:
    if isinstance(kind, DoubleType | FloatType):
        return F.round(c, digits)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_rounded(c[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _rounded(x, kind.elementType, digits))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _rounded(v, kind.valueType, digits))
    return c


def document(sections: dict[str, DataFrame], texts: dict[str, str] | None = None, limit: int = 10_000) -> str:
    """One JSON document of small result tables and static texts: what an analysis publishes.  A section of more than
    ``limit`` rows raises."""
    out: dict[str, object] = dict(texts or {})
    for name, df in sections.items():
        out[name] = [json.loads(r[0]) for r in few(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name)), limit)]
    return json.dumps(out, ensure_ascii=False, indent=1)


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    cells = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in few(rows, limit)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *cells])


def registry_markdown(title: str, note: str, rows: DataFrame, heading: str, limit: int = 1000) -> str:
    """A registry as Markdown: a title, a note, and a section for each row with its fields as bullets."""
    parts = [f"# {title}", note]
    for r in few(rows, limit):
        parts.append("\n".join([f"## {r[heading]}", *[f"- {k}: {v}" for k, v in r.asDict().items() if k != heading and v is not None]]))
    return "\n\n".join(parts) + "\n"


def console_table(rows: DataFrame, limit: int = 100) -> str:
    """Columns of even width, numbers to the right."""
    found = few(rows, limit)
    cells = [[("-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in found]
    right = [bool(found) and all(isinstance(r[i], int | float) or r[i] is None for r in found) for i in range(len(rows.columns))]
    widths = [max(map(len, column)) for column in zip(rows.columns, *cells)]
    lines = [[c.rjust(w) if r else c.ljust(w) for c, w, r in zip(row, widths, right)] for row in [rows.columns, *cells]]
    return "\n".join("  ".join(row).rstrip() for row in lines)
