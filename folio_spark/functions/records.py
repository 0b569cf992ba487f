"""JSON records, options and templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.assemble import strip
from .binding import let

# The review record, its marks, and the length of a fallback comment.
ISSUE = "struct<file:string,line_range:string,severity:string,category:string,title:string,description:string,suggestion:string>"
REVIEW = (
    "struct<summary:struct<total_issues:bigint,high_severity:bigint,medium_severity:bigint,low_severity:bigint>,"
    f"issues:array<{ISSUE}>,overall_comment:string>"
)
SEVERITY_MARKS = {"high": "🔴", "medium": "🟡", "low": "🔵"}
CATEGORY_MARKS = {
    "bug": "🐛",
    "security": "🔒",
    "performance": "⚡",
    "readability": "📖",
    "best-practice": "✨",
}
FALLBACK_COMMENT = 500


def json_get(record: Column, path: str, default: str | None = None) -> Column:
    """Value at a dotted path; the default where it is absent or null."""
    found = F.get_json_object(record, "$." + path)
    return found if default is None else F.coalesce(found, F.lit(default))


def json_section(record: Column, name: str) -> Column:
    """A whole sub-object as JSON text; a missing one raises."""
    section = F.get_json_object(record, "$." + name)
    return F.coalesce(section, F.raise_error(F.lit(f"missing section: {name}")).cast("string"))


def missing_paths(record: Column, required: list[str]) -> Column:
    """Names of the required paths a record lacks."""
    gaps = [F.when(F.get_json_object(record, "$." + p).isNull(), F.lit(p)) for p in required]
    return F.array_compact(F.array(*gaps))


def typed_record(record: Column, schema: T.StructType, defaults: dict) -> Column:
    """Typed struct with per-field defaults; unknown keys are dropped.

    ``defaults`` nests like the schema.
    """
    parsed = F.from_json(record, schema)

    def fill(struct: T.StructType, at: Column, values: dict) -> Column:
        fields = []
        for field in struct.fields:
            value, default = at[field.name], values.get(field.name)
            if isinstance(field.dataType, T.StructType):
                value = fill(field.dataType, value, default or {})
            elif default is not None:
                value = F.coalesce(value, F.lit(default).cast(field.dataType))
            fields.append(value.alias(field.name))
        return F.struct(*fields)

    return fill(schema, parsed, defaults)


def strip_code_fence(text: Column) -> Column:
    out = F.regexp_replace(strip(text), r"^```(json)?", "")
    return strip(F.regexp_replace(out, r"```$", ""))


def embedded_json(text: Column) -> Column:
    """The text itself if it parses as an object, else its first ``{`` to last ``}``; null without braces."""

    def find(body):
        whole = F.get_json_object(body, "$").isNotNull() & body.startswith("{")
        inner = F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))
        return F.when(whole, body).otherwise(inner)

    return let(strip_code_fence(text), find)


def review_record(text: Column, comment: int = FALLBACK_COMMENT) -> Column:
    """Parsed review; of text without a usable record the first ``comment`` characters become an empty one's comment."""
    zero = F.lit(0).cast("bigint")
    fallback = F.struct(
        F.struct(*[zero.alias(n) for n in ("total_issues", "high_severity", "medium_severity", "low_severity")]).alias("summary"),
        F.array().cast(f"array<{ISSUE}>").alias("issues"),
        F.substring(strip_code_fence(text), 1, comment).alias("overall_comment"),
    )

    def parse(record):
        usable = F.get_json_object(record, "$").isNotNull()
        return F.when(usable, F.from_json(record, REVIEW)).otherwise(fallback)

    return let(embedded_json(text), parse)


def marked(value: Column, marks: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, mark in marks.items():
        out = F.when(value == key, F.lit(mark)).otherwise(out)
    return out


def issue_section(number, file, line, severity, category, title, description, suggestion) -> Column:
    """Markdown section of one issue; absent or empty line and suggestion leave no paragraph."""
    named = lambda label, value: F.concat(F.lit(f"**{label}**: "), value)
    head = F.concat(
        F.lit("#### "), number.cast("string"), F.lit(". "),
        marked(severity, SEVERITY_MARKS, "⚪"), F.lit(" "),
        marked(category, CATEGORY_MARKS, "📝"), F.lit(" "), title,
    )
    return F.concat_ws(
        "\n\n",
        head,
        named("File", F.concat(F.lit("`"), file, F.lit("`"))),
        named("Line", F.nullif(line, F.lit(""))),
        named("Severity", F.initcap(severity)),
        named("Category", category),
        named("Description", description),
        named("Suggestion", F.nullif(suggestion, F.lit(""))),
        F.lit("---"),
    )


def summary_section(total, high, medium, low) -> Column:
    lines = [("**Total Issues**", total), ("🔴 High Severity", high), ("🟡 Medium Severity", medium), ("🔵 Low Severity", low)]
    body = [F.concat(F.lit(f"- {label}: "), value.cast("string")) for label, value in lines]
    return F.concat(F.lit("### 📊 Summary\n\n"), F.concat_ws("\n", *body))


def review_markdown(review: Column) -> Column:
    """A whole review record as Markdown; issues are numbered in their order."""
    issues = F.transform(
        review["issues"],
        lambda i, n: issue_section(
            n + 1,
            F.coalesce(i["file"], F.lit("Unknown")),
            i["line_range"],
            F.coalesce(i["severity"], F.lit("low")),
            F.coalesce(i["category"], F.lit("best-practice")),
            F.coalesce(i["title"], F.lit("Issue")),
            F.coalesce(i["description"], F.lit("")),
            i["suggestion"],
        ),
    )
    s = review["summary"]
    count = lambda name: F.coalesce(s[name], F.lit(0))
    findings = F.when(
        F.size(review["issues"]) > 0,
        F.concat(F.lit("### 🔍 Findings\n\n"), F.array_join(issues, "\n\n")),
    )
    overall = F.when(
        F.coalesce(review["overall_comment"], F.lit("")) != "",
        F.concat(F.lit("### 💬 Overall Assessment\n\n"), review["overall_comment"]),
    )
    return F.concat_ws(
        "\n\n",
        summary_section(*[count(n) for n in ("total_issues", "high_severity", "medium_severity", "low_severity")]),
        findings,
        overall,
    )


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` placeholders."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def page_file(page: Column) -> Column:
    """``page_0007``; longer numbers keep all digits."""
    digits = page.cast("string")
    return F.concat(F.lit("page_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def iso_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
