"""Annotation facts from the lines of comment blocks: declarations, references and what is wrong with them.

All of it is DataFrame operations. A block's lines are dealt once by (path, block_no); a tag begins a
section, which its description ends at the next tag of any kind. Markers of a declaration (planned,
deprecated, strictness) belong to its section. Dialect 1 of the markers: in the header, or in the next line.
Dialect 0: a line of its own anywhere later in the block, for the last claim declared before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.sources.comments import TAGS

_TAG = r"^@(" + "|".join(TAGS) + r")(?:\s+(.*))?$"
_BOUNDARY = r"^[@\\][A-Za-z]"
#: The columns of a section; ``prose`` are its non-blank lines, which ``text`` joins by spaces.
SECTION = ["path", "block_no", "line", "keyword", "rest", "text", "prose", "marker", "marker_rest", "marker_line", "owned_line", "owned_body"]
_HEADER = r"^(\S+)(?:\s+@(planned|deprecated)(?:\s+(\S.*))?)?$"


def tag_sections(lines: DataFrame) -> DataFrame:
    """One row a tag that owns its section, with the columns of SECTION.

    ``text`` joins the section's other non-blank lines by spaces. Sections of foreign tags are left out, as are
    lines before the first tag. Empty input has no rows; null texts count as blank.
    """
    block = Window.partitionBy("path", "block_no").orderBy("line")
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = lines.withColumn("text", text).withColumn("keyword", F.nullif(F.regexp_extract("text", _TAG, 1), F.lit("")))
    near = F.lag("keyword").over(block)
    last = F.last(F.when(F.col("text") != "", F.coalesce("keyword", F.lit("-"))), True).over(before)
    marks = F.coalesce(
        (F.col("keyword").isin("planned", "deprecated") & (near.isin("spec", "group")))
        | (F.col("keyword") == "planned") & last.isin("module", "area")
        | (F.col("keyword") == "strictness") & (last == "pattern"),
        F.lit(False),
    )
    rows = rows.select("*", marks.alias("marks"))
    opens = F.col("text").rlike(_BOUNDARY) & ~F.col("marks")
    rows = rows.select("*", opens.alias("opens")).withColumn("section", F.sum(F.col("opens").cast("int")).over(block))
    prose = F.when(~F.col("opens") & ~F.col("marks") & (F.col("text") != ""), F.struct("line", "text"))
    tag_rest = F.regexp_extract("text", _TAG, 2)
    got = rows.where("section > 0").groupBy("path", "block_no", "section").agg(
        F.min("line").alias("line"),
        F.min_by("keyword", F.when(F.col("opens"), F.col("line"))).alias("keyword"),
        F.min_by(tag_rest, F.when(F.col("opens"), F.col("line"))).alias("rest"),
        F.array_sort(F.collect_list(prose)).alias("prose"),
        F.max(F.when(F.col("marks"), F.col("line"))).alias("marker_line"),
        F.max(F.when(F.col("marks"), F.col("keyword"))).alias("marker"),
        F.max(F.when(F.col("marks"), tag_rest)).alias("marker_rest"),
        F.first("owned_line").alias("owned_line"),
        F.first("owned_body").alias("owned_body"),
    )
    return got.where("keyword IS NOT NULL").withColumn("text", F.array_join(F.col("prose.text"), " ")).select(*SECTION)


def _lifecycle(sections: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    header = lambda k: F.nullif(F.regexp_extract("rest", _HEADER, k), F.lit(""))
    release = lambda word: F.coalesce(F.when(header(2) == word, header(3)), F.when((F.col("marker") == word) & header(2).isNull(), F.nullif(F.col("marker_rest"), F.lit(""))))
    state = lambda word: F.coalesce(header(2) == word, F.lit(False)) | F.coalesce((F.col("marker") == word) & header(2).isNull(), F.lit(False))
    return sections.where(F.col("keyword").isin(*kinds)).select(
        header(1).alias("id"), F.col("keyword").alias("kind"), "text", state("planned").alias("planned"), release("planned").alias("planned_release"),
        state("deprecated").alias("deprecated"), release("deprecated").alias("deprecated_release"), "path", "line",
    ).where("id IS NOT NULL")


def specs(sections: DataFrame, dialect: int = 1) -> DataFrame:
    """Claims and groups. A group with a lifecycle marker is no declaration (see diagnostics)."""
    if dialect:
        return _lifecycle(sections, ("spec", "group")).where("kind = 'spec' OR NOT (planned OR deprecated)")
    decls = sections.where(F.col("keyword").isin("spec", "group") & _single(F.col("rest")))
    out = decls.select(F.col("rest").alias("id"), F.col("keyword").alias("kind"), "text", "path", "block_no", "line")
    marks = legacy_marks(sections).where("of.keyword = 'spec'").groupBy("path", "block_no", F.col("of.line").alias("line"))
    named = lambda w: F.col("keyword") == w
    release = lambda w: F.max_by(F.nullif("rest", F.lit("")), F.when(named(w), F.col("at")))
    marks = marks.agg(F.bool_or(named("planned")).alias("p"), release("planned").alias("planned_release"), F.bool_or(named("deprecated")).alias("d"), release("deprecated").alias("deprecated_release"))
    false = lambda c: F.coalesce(c, F.lit(False))
    return out.join(marks, ["path", "block_no", "line"], "left").select("id", "kind", "text", false("p").alias("planned"), "planned_release", false("d").alias("deprecated"), "deprecated_release", "path", "line")


def legacy_marks(sections: DataFrame) -> DataFrame:
    """Lifecycle tags of dialect 0 (keyword, rest, at) with the last claim or group (of: line, keyword) before them in their block."""
    own = sections.select("path", "block_no", F.col("line").alias("at"), "keyword", "rest").unionByName(
        sections.where("marker IN ('planned', 'deprecated') AND keyword IN ('spec', 'group')").select("path", "block_no", F.col("marker_line").alias("at"), F.col("marker").alias("keyword"), F.col("marker_rest").alias("rest")))
    before = Window.partitionBy("path", "block_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    decl = F.when(F.col("keyword").isin("spec", "group"), F.struct(F.col("at").alias("line"), "keyword"))
    return own.withColumn("of", F.last(decl, True).over(before)).where(F.col("keyword").isin("planned", "deprecated"))


def modules(sections: DataFrame) -> DataFrame:
    """Modules and areas; neither can be deprecated and an area can't be planned."""
    return _lifecycle(sections, ("module", "area")).where("NOT deprecated AND (kind = 'module' OR NOT planned)").drop("deprecated", "deprecated_release")


#: What an attestation says.
ATTESTED = ("artifact", "owner", "last_reviewed", "review_interval_days")


def attestations(sections: DataFrame) -> DataFrame:
    """Attest sections with a lone id: ``said`` (line, key, value of each prose line; key is null without a colon) and the value of each key of ATTESTED."""
    rows = sections.where(F.col("keyword").isin("attests", "fileattests") & _single(F.col("rest")))
    colon = lambda p: F.instr(p["text"], ":")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    said = F.transform("prose", lambda p: F.struct(
        p["line"].alias("line"), F.when(colon(p) > 0, strip(F.substring_index(p["text"], ":", 1))).alias("key"),
        F.when(colon(p) > 0, strip(F.substr(p["text"], F.instr(p["text"], ":") + 1))).alias("value")))
    rows = rows.withColumn("said", said)
    first = lambda k: F.get(F.filter("said", lambda s: s["key"] == k), 0)
    return rows.select("path", "block_no", "line", "keyword", F.col("rest").alias("spec_id"), "said", *[first(k).alias(k) for k in ATTESTED])


def _attest_faults(rows: DataFrame) -> DataFrame:
    """rows with ``faults``: (line, message) of what is wrong with an attestation."""
    fault = lambda line, message: F.struct(line.alias("line"), message.alias("message"))

    def of_line(s: Column, i: Column) -> Column:
        earlier = F.get(F.filter("said", lambda x: (x["key"] == s["key"]) & (x["line"] < s["line"])), 0)
        return F.when(s["key"].isNull(), fault(s["line"], F.lit("attestation metadata must use key: value format"))).when(
            ~s["key"].isin(*ATTESTED), fault(s["line"], F.concat(F.lit("unknown attestation metadata `"), s["key"], F.lit("`")))).when(
            earlier.isNotNull(), fault(s["line"], F.concat(F.lit("duplicate attestation metadata `"), s["key"], F.lit("`; first declared on line "), earlier["line"].cast("string"))))

    value = lambda k: F.col(k)["value"]
    missing = [F.when(F.coalesce(value(k), F.lit("")) == "", fault(F.coalesce(F.col(k)["line"], F.col("line")), F.lit(f"missing required attestation metadata `{k}`"))) for k in ATTESTED[:3]]
    # the calendar date of that day, of any number of digits
    date = F.when((value("last_reviewed") != "") & F.expr("try_to_date(last_reviewed.value, 'yyyy-M-d')").isNull(), fault(F.col("last_reviewed")["line"], F.lit("last_reviewed must use YYYY-MM-DD format")))
    days = value("review_interval_days").try_cast("bigint")
    wrong = F.col("review_interval_days").isNotNull() & ~F.coalesce(value("review_interval_days").rlike(r"^\+?[0-9]+$") & days.between(1, 4294967295), F.lit(False))
    interval = F.when(wrong, fault(F.col("review_interval_days")["line"], F.lit("review_interval_days must be a positive integer")))
    every = F.concat(F.transform("said", of_line), F.array(*missing, interval, date))
    return rows.withColumn("faults", F.filter(every, lambda f: f.isNotNull()))


def attests(sections: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """Attestations without a fault. The body of an @attests is its block, of a @fileattests the file."""
    good = _attest_faults(attestations(sections)).where(F.size("faults") == 0)
    block = lines.groupBy("path", "block_no").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
    block = block.select("path", "block_no", F.regexp_replace(F.array_join(F.col("all.text"), "\n"), r"^\s+|\s+$", "").alias("__block"))
    whole = files.select("path", F.regexp_replace("text", r"\s+$", "").alias("__whole"))
    out = good.join(block, ["path", "block_no"], "left").join(whole, "path", "left")
    file = F.col("keyword") == "fileattests"
    return out.select(
        "spec_id", F.col("artifact.value").alias("artifact"), F.col("owner.value").alias("owner"), F.col("last_reviewed.value").alias("last_reviewed"),
        F.col("review_interval_days.value").cast("int").alias("review_interval_days"), F.when(file, "file").otherwise("block").alias("scope"), "path", "line", F.when(file, F.col("__whole")).otherwise(F.col("__block")).alias("body"))


def _single(rest: Column) -> Column:
    return rest.rlike(r"^\S+$")


def _first_in_block(sections: DataFrame, item: str, file: str) -> DataFrame:
    """The references with a lone id; ``nth`` numbers them in their block."""
    rows = sections.where(F.col("keyword").isin(item, file) & _single(F.col("rest")))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("path", "block_no").orderBy("line")))


def _references(rows: DataFrame, files: DataFrame, item: str, id: str) -> DataFrame:
    """Item references with their item; file references with their whole file, right-trimmed, and no item line."""
    whole = files.select("path", F.regexp_replace("text", r"\s+$", "").alias("__whole"))
    at = rows.where((F.col("keyword") == item) & F.col("owned_line").isNotNull()).select(F.col("rest").alias(id), "path", "line", F.col("owned_line").alias("body_line"), F.col("owned_body").alias("body"))
    by_file = rows.where(F.col("keyword") != item).join(whole, "path", "left")
    return at.unionByName(by_file.select(F.col("rest").alias(id), "path", "line", F.lit(None).cast("int").alias("body_line"), F.col("__whole").alias("body")))


def verifies(sections: DataFrame, files: DataFrame) -> DataFrame:
    """The first reference of a block; one that fails for lack of an item counts as the first too."""
    return _references(_first_in_block(sections, "verifies", "fileverifies").where("nth = 1"), files, "verifies", "spec_id")


def implements(sections: DataFrame, files: DataFrame) -> DataFrame:
    return _references(_first_in_block(sections, "implements", "fileimplements"), files, "implements", "module_id")


def applications(sections: DataFrame, files: DataFrame) -> DataFrame:
    return _references(_first_in_block(sections, "applies", "fileapplies"), files, "applies", "pattern_id")


def patterns(sections: DataFrame) -> DataFrame:
    """Definitions; strictness is medium unless its marker says otherwise."""
    level = F.when(F.col("marker_rest").isin("high", "medium", "low"), F.col("marker_rest")).otherwise("medium")
    return sections.where((F.col("keyword") == "pattern") & _single(F.col("rest"))).select(F.col("rest").alias("pattern_id"), level.alias("strictness"), "text", "path", "line")


#: Messages.
NO_ID = "missing {what} id after @{tag}"
MORE = "unexpected trailing content after @{tag} {what} id"
NO_ITEM = "@{tag} must attach to the next supported item"
ONLY_ONE = "annotation block may contain only one @verifies"
ONLY_ONE_FILE = "annotation block may contain only one @verifies or @fileverifies"
IN_PROSE = "@applies and @fileapplies must attach to source code, not markdown declarations"
PLANNED_GROUP = "@planned may only apply to @spec, not @group"
DEPRECATED_GROUP = "@deprecated may only apply to @spec, not @group"
NOT_ADJACENT = "must be adjacent to exactly one owning @spec; the backward-looking form is not allowed in version 1"
NO_OWNER = "must be adjacent to exactly one owning @spec"
NOT_AFTER = "must appear after a @spec in the same block"

#: Reference tags and what they name.
REFERENCES = {"verifies": "spec", "fileverifies": "spec", "attests": "spec", "fileattests": "spec", "implements": "module", "fileimplements": "module", "applies": "pattern", "fileapplies": "pattern", "pattern": "pattern"}


def errors(df: DataFrame, message: Column) -> DataFrame:
    return df.select(F.lit("error").alias("severity"), "path", "line", message.alias("message")).where("message IS NOT NULL")


def _by_tag(template: str) -> Column:
    return F.coalesce(*[F.when(F.col("keyword") == tag, F.lit(template.format(tag=tag, what=what))) for tag, what in REFERENCES.items()])


def diagnostics(sections: DataFrame, dialect: int = 1) -> DataFrame:
    """(severity, path, line, message) of references, headers and markers that can't be read; ordered() sorts them."""
    refs = sections.where(F.col("keyword").isin(*REFERENCES))
    said = F.when(F.col("rest") == "", _by_tag(NO_ID)).when(~_single(F.col("rest")), _by_tag(MORE))
    lone = F.when(F.col("owned_line").isNull() & F.col("keyword").isin("verifies", "implements", "applies"), _by_tag(NO_ITEM))
    first = _first_in_block(sections, "verifies", "fileverifies")
    later = first.where("nth > 1")
    heads = refs.join(later.select("path", "line"), ["path", "line"], "left_anti")
    out = errors(heads, F.coalesce(said, lone)).unionByName(errors(later, F.when(F.col("keyword") == "fileverifies", ONLY_ONE_FILE).otherwise(ONLY_ONE)))
    faults = _attest_faults(attestations(sections)).select("path", F.explode("faults").alias("f")).select("path", F.col("f.line").alias("line"), F.col("f.message").alias("message"))
    return out.unionByName(errors(faults, F.col("message"))).unionByName(_marker_faults(sections, dialect))


def _marker_faults(sections: DataFrame, dialect: int) -> DataFrame:
    marks = legacy_marks(sections)
    tag = F.concat(F.lit("@"), F.col("keyword"), F.lit(" "))
    group = F.when(F.col("keyword") == "planned", PLANNED_GROUP).otherwise(DEPRECATED_GROUP)
    if dialect == 0:
        return errors(marks.withColumnRenamed("at", "line"), F.when(F.col("of").isNull(), F.concat(tag, F.lit(NOT_AFTER))).when(F.col("of.keyword") == "group", group))
    # a marker that is a section of its own is next to no declaration
    own = sections.where(F.col("keyword").isin("planned", "deprecated")).select("path", "block_no", F.col("line").alias("at"))
    alone = marks.join(own, ["path", "block_no", "at"], "left_semi").withColumnRenamed("at", "line")
    out = errors(alone, F.concat(tag, F.when(F.col("of").isNotNull(), NOT_ADJACENT).otherwise(NO_OWNER)))
    wrong = sections.where("keyword = 'group' AND marker IN ('planned', 'deprecated')").select("path", F.col("marker_line").alias("line"), F.col("marker").alias("keyword"))
    return out.unionByName(errors(wrong, group))


def ordered(diagnostics: DataFrame) -> DataFrame:
    """Sorted by severity (errors first), path by component, line and message; equal ones once."""
    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    return diagnostics.select("severity", "path", "line", "message").distinct().orderBy(rank, F.split("path", "/"), "line", "message")
