"""Acts of hidden works as XML: one row an act, with its works, sections of documentation and materials (rows 025, 026).

The schema of these files nests lists at depths that differ between issues, so elements are found by their names at any
depth. Namespaces and their prefixes play no part. A document that is no XML is kept apart instead of ending the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tristage.functions.match import only

#: Names of elements.
ACT, SECTION, SHORT, WORK, MATERIAL, RULE, SCHEMA, QUALITY = "actInfo", "workDocumentationSectionsListItem", "shortWorkDocumentationSectionsListItem", "worksListItem", "usedMaterialsListItem", "technicalRegulationDetailsListItem", "asBuiltSchemasListItem", "untypedQualityApproveDocumentsListItem"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """relative_path and content of the XML files under path, as Spark reads whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").load(path)
    return files.select(F.col("path").alias("relative_path"), F.decode("content", "UTF-8").alias("content"))


def plain(xml: Column) -> Column:
    """Without prolog, comments, namespaces and prefixes of element names."""
    x = F.regexp_replace(F.coalesce(xml, F.lit("")), r"(?s)^\x{FEFF}|<\?xml.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "")
    x = F.regexp_replace(x, r"""\s(?:xmlns(?::[\w.-]+)?|[\w.-]+:[\w.-]+)\s*=\s*(?:"[^"]*"|'[^']*')""", "")
    return F.trim(F.regexp_replace(x, r"(</?)[\w.-]+:", "$1"))


def blocks(xml: Column, name: str) -> Column:
    """Every element of a name that does not hold another of that name, as text."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)(<{name}(?:\s[^>]*)?>.*?</{name}>)"), F.lit(1))


def first(xml: Column, *path: str) -> Column:
    """The first text at a path anywhere in xml; null if there is none or it is empty."""
    found = F.filter(F.xpath(xml, F.lit("//" + "/".join(path) + "/text()")), lambda t: F.trim(t) != "")
    return F.when(xml.contains("<" + path[-1]), F.trim(F.get(found, 0)))  # no document is built for what isn't there


def every(xml: Column, name: str) -> Column:
    found = F.filter(F.transform(F.xpath(xml, F.lit(f"//{name}/text()")), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(xml.isNull() | xml.contains("<" + name), found).otherwise(F.array().cast("array<string>"))


def _person(xml: Column, name: str) -> Column:
    block = F.get(blocks(xml, name), 0)
    whole = F.concat_ws(" ", *(F.trim(F.xpath_string(block, F.lit(f"//{n}"))) for n in ("lastName", "firstName", "middleName")))
    return F.when(block.isNotNull(), F.struct(F.nullif(F.trim(F.regexp_replace(whole, r"\s+", " ")), F.lit("")).alias("fio"), first(block, "position").alias("position")))


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acts and files that are no XML (relative_path, error).

    Acts: relative_path, doc_kind, act_number, act_date, act_name, object_name, work_begin, work_end, works (name, place),
    sections (code, name, sheets), materials (name, quality_documents), regulations, schemas, executor. A section of the
    short list counts if its code isn't among the others. Files without number, works and sections are no acts.
    """
    kind = "_corrupt_record string"
    rows = files.select("relative_path", plain(F.col("content")).alias("_x"))
    checked = rows.withColumn("_bad", (F.col("_x") == "") | ~F.col("_x").startswith("<") | F.from_xml("_x", kind, {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull())
    x = F.when(~F.col("_bad"), F.col("_x"))
    acts = only(checked, ~F.col("_bad")).withColumn("_x", x)
    a = F.col("_x")
    works = F.transform(blocks(a, WORK), lambda b: F.struct(first(b, "workDescription", "workName").alias("name"), first(b, "location", "place").alias("place")))
    long = F.transform(blocks(a, SECTION), lambda b: F.struct(first(b, "workDocumentationSectionCode").alias("code"), first(b, "workDocumentationSectionName").alias("name"), every(b, "sheetNumber").alias("sheets")))
    short = F.transform(blocks(a, SHORT), lambda b: F.struct(first(b, "number").alias("code"), first(b, "name").alias("name"), F.array().cast("array<string>").alias("sheets")))
    acts = acts.withColumn("_long", long)
    codes = F.transform("_long", lambda s: s.code)
    more = F.filter(short, lambda s: s.code.isNotNull() & ~F.coalesce(F.array_contains(codes, s.code), F.lit(False)))
    document = lambda b: F.struct(first(b, "name").alias("name"), first(b, "number").alias("number"), first(b, "date").alias("date"))
    materials = F.transform(blocks(a, MATERIAL), lambda b: F.struct(first(b, MATERIAL, "name").alias("name"), F.transform(blocks(b, QUALITY), document).alias("quality_documents")))
    rules = F.transform(blocks(a, RULE), lambda b: F.struct(first(b, "number").alias("number"), first(b, "name").alias("name")))
    schemas = F.transform(blocks(a, SCHEMA), document)
    out = acts.select(
        "relative_path", F.upper(F.regexp_extract(a, r"^<([\w.-]+)", 1)).alias("doc_kind"),
        F.coalesce(first(a, "documentInfo", "number"), first(a, "docCode")).alias("act_number"), F.coalesce(first(a, "documentInfo", "date"), first(a, "docDate")).alias("act_date"), F.coalesce(first(a, "documentInfo", "name"), first(a, "docName")).alias("act_name"),
        first(a, "permanentObjectName").alias("object_name"), first(a, "worksDate", "beginDate").alias("work_begin"), first(a, "worksDate", "endDate").alias("work_end"),
        works.alias("works"), F.concat("_long", F.array_distinct(more)).alias("sections"), materials.alias("materials"), rules.alias("regulations"), schemas.alias("schemas"), _person(a, "workExecutorRepresentative").alias("executor"),
    )
    return only(out, (F.col("act_number").isNotNull()) | (F.size("works") > 0) | (F.size("sections") > 0)), checked.where("_bad").select("relative_path", F.lit("NOT_XML").alias("error"))


def sheets(acts: DataFrame) -> DataFrame:
    """relative_path, act_number, code and sheet: the sheets that acts cite, one row each."""
    s = acts.select("relative_path", "act_number", F.explode("sections").alias("s"))
    return s.select("relative_path", "act_number", F.col("s.code").alias("code"), F.explode("s.sheets").alias("sheet"))
