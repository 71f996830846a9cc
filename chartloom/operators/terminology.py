"""Terminology: seed codes, lookups by name or by a computed key, candidate codings, manifests by system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions.terminology import CONFIDENCE, SYSTEM_URIS, SYSTEMS, seed_rows
from chartloom.operators.lineage import fixed
from chartloom.operators.validation import confidence_number

CODING = "struct<system:string,code:string,display:string,release_version:string,confidence:double>"
_SEED = "canonical_name string, system string, code string, display string, release_version string, confidence string"


def system_uri(label: Column) -> Column:
    """The URI of a system's name; null for a name that is not known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SYSTEM_URIS.items() for x in kv]), label)


def system_label(uri: Column) -> Column:
    """The name of a system's URI; any other URI stays as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in SYSTEM_URIS.items() for x in (v, k)]), uri), uri)


# Parts of a system's URL, in the order in which they are tried.
URL_PARTS = (("icd-10-cm", "ICD-10-CM"), ("snomed", "SNOMED-CT"), ("loinc", "LOINC"), ("rxnorm", "RxNorm"), ("cpt", "CPT"), ("hcpcs", "HCPCS"))
# Broad codes of imaging modalities.
IMAGING = (
    ("mri", "SNOMED-CT", "113091000", "Magnetic resonance imaging", None, "low"),
    ("ct", "SNOMED-CT", "77477000", "Computed tomography", None, "low"),
    ("ultrasound", "SNOMED-CT", "16310003", "Ultrasonography", None, "low"),
    ("x-ray", "SNOMED-CT", "363680008", "Radiographic imaging procedure", None, "low"),
)


def system_of_url(url: Column) -> Column:
    """The name of the system whose part the URL holds, the first of URL_PARTS; null for any other."""
    return F.coalesce(*[F.when(F.contains(url, F.lit(part)), label) for part, label in URL_PARTS])


def seed(rows: DataFrame) -> DataFrame:
    """Seed rows (system names, confidence words) -> (canonical_name, system, code, display, release_version, confidence).

    Names are in lower case, systems are URIs, an unknown confidence word is 0.5.  An unknown system is an error.
    """
    uri = F.coalesce(system_uri(F.col("system")), F.raise_error(F.concat(F.lit("unknown code system: "), F.coalesce("system", F.lit("null")))).cast("string"))
    return rows.select(F.lower("canonical_name").alias("canonical_name"), uri.alias("system"), "code", "display", "release_version", confidence_number(F.col("confidence")).alias("confidence"))


def built_in_seed(spark: SparkSession) -> DataFrame:
    return seed(fixed(spark, seed_rows(), _SEED))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A seed file: one JSON array of rows; fields beyond the known ones are ignored."""
    return seed(spark.read.schema(_SEED).option("multiLine", True).json(path))


def lookup_key(kind: Column, name: Column, attributes: Column) -> Column:
    """The name an entity is looked up by: its normalized term for a medication or a medication dose, else its own name."""
    term = F.nullif(F.try_element_at(attributes, F.lit("normalizedTerm")), F.lit(""))
    return F.lower(F.when((kind == "medication") | (name == "medication dose"), F.coalesce(term, name)).otherwise(name))


def modality_key(kind: Column, attributes: Column) -> Column:
    """The modality that an imaging entity is looked up by besides its name; null for any other entity."""
    return F.when(kind == "imaging", F.lower(F.try_element_at(attributes, F.lit("modality"))))


def candidate_codings(entities: DataFrame, codes: DataFrame) -> DataFrame:
    """entities(entity_type, canonical_name, attributes, ...) gain codings: those of the lookup key, then those of the modality."""
    own = with_codings(entities, codes, lookup_key(F.col("entity_type"), F.col("canonical_name"), F.col("attributes"))).withColumnRenamed("codings", "_static")
    imaging = seed(fixed(entities.sparkSession, IMAGING, _SEED))
    both = with_codings(own, imaging, modality_key(F.col("entity_type"), F.col("attributes")))
    return both.withColumn("codings", F.concat("_static", "codings")).drop("_static")


def with_codings(entities: DataFrame, codes: DataFrame, key: Column, systems: list[str] | None = None) -> DataFrame:
    """entities gain codings: the codes of their key, each system and code once, highest confidence first, then by system and code.

    systems: URIs, where only these are wanted.  The codes of one name are gathered on the code table's side, by an equi join
    that Spark turns into a broadcast where the table is small.
    """
    kept = codes if systems is None else codes.where(F.col("system").isin(systems))
    once = kept.groupBy(F.lower("canonical_name").alias("_name"), "system", "code").agg(F.max_by(F.struct("display", "release_version", "confidence"), "confidence").alias("c"))
    one = F.struct((-F.col("c.confidence")).alias("rank"), "system", "code", F.col("c.display").alias("display"), F.col("c.release_version").alias("release_version"), F.col("c.confidence").alias("confidence"))
    lists = once.groupBy("_name").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("rank")).cast(f"array<{CODING}>").alias("_codings"))
    out = entities.withColumn("_key", key).join(lists, F.col("_key") == F.col("_name"), "left")
    return out.withColumn("codings", F.coalesce("_codings", F.array().cast(f"array<{CODING}>"))).drop("_key", "_name", "_codings")


def is_coded(codings: Column) -> Column:
    """Only a code of a pinned release makes a row coded."""
    return F.exists(codings, lambda c: c["release_version"].isNotNull())


def expansion(payloads: DataFrame) -> DataFrame:
    """(query_id, requested, raw) of value-set expansions as JSON -> (query_id, ord, system, code, display, confidence).

    The system is the requested one, else that of the entry's URL; entries without system, code or display are left out.
    Confidence is low.  A payload that is no JSON, or has no expansion, gives no rows.
    """
    kind = "expansion struct<contains:array<struct<system:string,code:string,display:string>>>"
    rows = payloads.select("query_id", "requested", F.posexplode(F.from_json("raw", kind)["expansion"]["contains"]).alias("ord", "c")).where("c.code <> '' AND c.display <> ''")
    system = F.coalesce("requested", system_of_url(F.col("c.system")))
    return rows.select("query_id", "ord", system.alias("system"), "c.code", "c.display", F.lit(CONFIDENCE["low"]).alias("confidence")).where("system IS NOT NULL")


def with_fallback(queries: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """(query_id, ord, system, code, display, confidence, provider, warning): a query's remote candidates, else its local ones.

    queries(query_id), remote and local(query_id, ord, system, code, display, confidence).
    """
    columns = ["query_id", "ord", "system", "code", "display", "confidence"]
    answered = remote.select("query_id").distinct()
    first = remote.select(*columns, F.lit("remote").alias("provider"), F.lit(None).cast("string").alias("warning"))
    rest = local.join(queries, "query_id", "left_semi").join(answered, "query_id", "left_anti")
    return first.unionByName(rest.select(*columns, F.lit("local").alias("provider"), F.lit("remote expansion gave no candidate").alias("warning")))


def merged_codings(own: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Codings (keys, ord, system, code, ...) of two tables, own first: each system and code of a key once, the first kept."""
    both = own.withColumn("_side", F.lit(0)).unionByName(more.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys, "system", "code").orderBy("_side", "ord")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_side")


def manifest(coded: DataFrame) -> DataFrame:
    """(system, n_candidates, n_selected, n_entities) of rows (entity_id, codings, status): one row for every known system.

    n_entities counts distinct entities with a code of the system.
    """
    rows = coded.select("entity_id", "status", F.explode("codings").alias("c")).select("entity_id", "status", system_label(F.col("c.system")).alias("system"))
    counts = rows.groupBy("system").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("status") == "selected").alias("n_selected"), F.countDistinct("entity_id").alias("n_entities"))
    every = coded.sparkSession.createDataFrame([(i, s) for i, s in enumerate(SYSTEMS)], "ord int, system string")
    return every.join(counts, "system", "left").select("ord", "system", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_candidates", "n_selected", "n_entities")])
