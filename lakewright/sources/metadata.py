"""Schema from metadata files: fields, objects, labels, pages, child relations.

Files are rows (path, file_class, text) as corpus.read_files gives them. XML that
cannot be read gives no row. Names compare without case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields that every object has, with their types.
UNIVERSAL = [("Id", "id"), ("OwnerId", "reference"), ("CreatedDate", "datetime"), ("CreatedById", "reference"), ("LastModifiedDate", "datetime"), ("LastModifiedById", "reference"), ("SystemModstamp", "datetime"), ("IsDeleted", "boolean")]
FIELD_XML = "fullName string, type string, referenceTo array<string>, relationshipName string"
OBJECT_XML = "label string, nameField struct<label:string,type:string>"
LABELS_XML = "labels array<struct<fullName:string,value:string>>"
FIELDS = ["object", "api_name", "field_type", "reference_to", "relationship_name", "source_path"]


def _parsed(files: DataFrame, kind: str, schema: str) -> DataFrame:
    text = F.regexp_replace("text", r"^\s*<\?xml[^>]*\?>", "")
    return files.where(F.col("file_class") == kind).select("path", F.from_xml(text, schema, {"mode": "PERMISSIVE"}).alias("x"))


def object_of(path):
    """The folder below `objects` that a file lies in."""
    return F.regexp_extract(path, r"/objects/([^/]+)/", 1)


def fields(files: DataFrame) -> DataFrame:
    """Field files, and the Name field that an object file declares."""
    own = _parsed(files, "field", FIELD_XML).where("x.fullName is not null and x.type is not null")
    own = own.select(object_of("path").alias("object"), F.col("x.fullName").alias("api_name"), F.col("x.type").alias("field_type"), F.coalesce("x.referenceTo", F.array().cast("array<string>")).alias("reference_to"), F.col("x.relationshipName").alias("relationship_name"), F.col("path").alias("source_path"))
    names = _parsed(files, "object", OBJECT_XML).where("x.nameField is not null")
    names = names.select(object_of("path").alias("object"), F.lit("Name").alias("api_name"), F.coalesce("x.nameField.type", F.lit("Text")).alias("field_type"), F.array().cast("array<string>").alias("reference_to"), F.lit(None).cast("string").alias("relationship_name"), F.col("path").alias("source_path"))
    return own.unionByName(names).where("object <> ''")


def objects(files: DataFrame) -> DataFrame:
    """(api_name, is_custom, fields): fields grouped by object."""
    return fields(files).groupBy(F.col("object").alias("api_name")).agg(F.array_sort(F.collect_list(F.struct("api_name", "field_type", "reference_to", "relationship_name", "source_path"))).alias("fields")).withColumn("is_custom", F.lower("api_name").endswith("__c"))


def labels(files: DataFrame) -> DataFrame:
    rows = _parsed(files, "labels", LABELS_XML).select("path", F.explode("x.labels").alias("l"))
    return rows.select(F.col("l.fullName").alias("full_name"), F.col("l.value").alias("value"), F.col("path").alias("source_path")).where("full_name is not null")


#: The first page tag, with `>` allowed inside quotes.
PAGE_TAG = r"(?is)<apex:page\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"


def pages(files: DataFrame) -> DataFrame:
    """(name, path, controllers): pages with the classes that they name, in lower case."""
    p = files.where("file_class = 'page'").select("path", F.regexp_extract("text", PAGE_TAG, 1).alias("tag"))
    def attr(name):
        return F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    both = F.concat(F.array(attr("controller")), F.split(attr("extensions"), ","))
    names = F.filter(F.transform(both, lambda c: F.lower(F.trim(c))), lambda c: c != "")
    return p.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "path", names.alias("controllers"))


def controllers(files: DataFrame) -> DataFrame:
    return pages(files).select(F.explode("controllers").alias("class_lc")).distinct()


def merge(local: DataFrame, bundled: DataFrame) -> DataFrame:
    """Fields of both; a local field comes before a bundled one of the same name."""
    ranked = local.withColumn("__r", F.lit(0)).unionByName(bundled.withColumn("__r", F.lit(1)))
    key = [F.lower("object").alias("__o"), F.lower("api_name").alias("__f")]
    best = ranked.groupBy(*key).agg(F.min(F.struct("__r", *FIELDS)).alias("m"))
    return best.select(*(F.col(f"m.{c}").alias(c) for c in FIELDS))


def with_universal(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows and the universal fields of every object, own ones first."""
    uni = spark.createDataFrame(UNIVERSAL, "api_name string, field_type string")
    every = rows.select("object").distinct().crossJoin(F.broadcast(uni))  # eight rows, fixed
    every = every.select("object", "api_name", "field_type", F.array().cast("array<string>").alias("reference_to"), F.lit(None).cast("string").alias("relationship_name"), F.lit(None).cast("string").alias("source_path"))
    return merge(rows, every)


def child_relationships(rows: DataFrame) -> DataFrame:
    """(parent, relationship, child) of lookups that name one; custom names end in __r."""
    named = rows.where("relationship_name is not null and size(reference_to) > 0")
    rel = F.when(F.lower("api_name").endswith("__c"), F.concat("relationship_name", F.lit("__r"))).otherwise(F.col("relationship_name"))
    return named.select(F.explode("reference_to").alias("parent"), rel.alias("relationship"), F.col("object").alias("child")).distinct()


def relationship_field(name):
    """X__r as the field that it goes through, X__c; other names as they are."""
    return F.regexp_replace(name, r"(?i)__r$", "__c")


def lookup_fields(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """paths (object, name) with the field meant: the field itself, X__c for
    X__r, or XId for X where that refers to something."""
    f = rows.select(F.lower("object").alias("o"), F.lower("api_name").alias("n"), "field_type", "reference_to")
    target = [(F.lower("name"), 0, F.lit(True)), (F.lower(relationship_field("name")), 1, F.lit(True)), (F.concat(F.lower("name"), F.lit("id")), 2, ~F.lower("name").endswith("__r"))]
    tries = paths.select("object", "name", F.explode(F.array(*(F.struct(n.alias("n"), F.lit(r).alias("r"), ok.alias("ok")) for n, r, ok in target))).alias("t")).where("t.ok")
    hit = tries.join(f, (F.lower("object") == F.col("o")) & (F.col("t.n") == F.col("n"))).where((F.col("t.r") == 0) | (F.size("reference_to") > 0))
    best = hit.groupBy("object", "name").agg(F.min(F.struct(F.col("t.r").alias("r"), "n", "field_type", "reference_to")).alias("m"))
    return paths.join(best, ["object", "name"], "left").select("object", "name", F.col("m.n").alias("field"), F.col("m.field_type").alias("field_type"), F.col("m.reference_to").alias("reference_to"))


def standard_classes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalogue of platform classes; those without members are left out."""
    schema = "namespace string, name string, kind string, methods array<struct<name:string,returnType:string,isStatic:boolean,params:array<struct<name:string,type:string>>>>, properties array<struct<name:string,type:string>>"
    df = spark.read.schema(schema).json(path)
    return df.where(F.coalesce(F.size("methods"), F.lit(0)) + F.coalesce(F.size("properties"), F.lit(0)) > 0)


def class_by_name(classes: DataFrame) -> DataFrame:
    """One class per name; the System namespace wins."""
    rank = F.when(F.lower("namespace") == "system", 0).otherwise(1)
    best = classes.groupBy(F.lower("name").alias("name_lc")).agg(F.min(F.struct(rank.alias("r"), "namespace", "name")).alias("m"))
    return classes.join(best.select("name_lc", F.col("m.namespace").alias("__ns"), F.col("m.name").alias("__n")), (F.col("namespace") == F.col("__ns")) & (F.col("name") == F.col("__n"))).drop("__ns", "__n")


def overloads(classes: DataFrame) -> DataFrame:
    """(class_lc, name_lc, arity, params, return_type) of every platform method."""
    m = classes.select(F.lower("name").alias("class_lc"), F.explode("methods").alias("m"))
    return m.select("class_lc", F.lower("m.name").alias("name_lc"), F.size("m.params").alias("arity"), F.transform("m.params", lambda p: p["type"]).alias("params"), F.col("m.returnType").alias("return_type"))


# Types of object fields in code; spellings that are not here have no type.
CODE_TYPES = {
    "String": "string text textarea picklist multipicklist combobox email phone url encryptedstring base64 name autonumber",
    "Boolean": "boolean check",
    "Date": "date",
    "Datetime": "datetime",
    "Time": "time timeonly",
    "Decimal": "currency percent double number",
    "Integer": "int integer",
    "Long": "long",
    "Id": "id reference",
}


def code_type(field_type):
    """The type in code of a field type, null if it has none."""
    out = F.when(F.lit(False), F.lit(""))
    for name, words in CODE_TYPES.items():
        out = out.when(F.lower(field_type).isin(*words.split()), name)
    return out
