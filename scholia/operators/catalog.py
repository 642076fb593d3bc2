"""The document catalog against object listings and the vector table: anti-joins, drift and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import percent_decoded, sharded_key, trimmed


def file_parts(objects: DataFrame) -> DataFrame:
    """objects with name, stem, ext and depth; hidden resource forks are left out."""
    name = F.element_at(F.split("key", "/"), -1)
    rows = objects.withColumn("name", name).where(~F.col("name").startswith("._"))
    return rows.withColumns({"stem": F.regexp_replace("name", r"\.[^.]*$", ""), "ext": F.regexp_extract("name", r"\.([^.]*)$", 1), "depth": F.size(F.split("key", "/"))})


def sources_of(objects: DataFrame) -> DataFrame:
    """stem, source_ext: a PDF before an HTML file of the same stem."""
    found = file_parts(objects).where(F.col("ext").isin("pdf", "html"))
    return found.groupBy("stem").agg(F.max("ext").alias("source_ext"))


def markdown_of(objects: DataFrame) -> DataFrame:
    """stem, key: of several files the one in the deepest folder, then the first by key."""
    found = file_parts(objects).where("ext = 'md'")
    return found.groupBy("stem").agg(F.min_by("key", F.struct((-F.col("depth")).alias("d"), "key")).alias("key"))


def orphan_files(catalog: DataFrame, papers: DataFrame) -> DataFrame:
    """Source files without a catalog row."""
    return sources_of(papers).join(catalog.select("stem"), "stem", "left_anti")


def orphans_by_stem(catalog: DataFrame, papers: DataFrame) -> DataFrame:
    """orphan_files, in the order of their stems."""
    return orphan_files(catalog, papers).orderBy("stem", "source_ext")


def converted_without_markdown(catalog: DataFrame, markdown: DataFrame) -> DataFrame:
    """Rows that say they are converted, without a markdown file."""
    done = catalog.where("conversion IS NOT NULL AND NOT coalesce(conversion.failed, false)")
    return done.join(markdown_of(markdown), "stem", "left_anti").select("stem")


def phantom_rows(catalog: DataFrame, papers: DataFrame, markdown: DataFrame) -> DataFrame:
    """Rows with neither a source nor a markdown file."""
    return catalog.join(sources_of(papers), "stem", "left_anti").join(markdown_of(markdown), "stem", "left_anti").select("stem")


def flag_drift(catalog: DataFrame, papers: DataFrame, markdown: DataFrame) -> DataFrame:
    """Rows whose stamps are missing though the files are there; failed conversions aside."""
    rows = (
        catalog.where("NOT coalesce(conversion.failed, false)")
        .join(markdown_of(markdown).select("stem", F.lit(True).alias("has_md")), "stem", "left")
        .join(sources_of(papers).select("stem", F.lit(True).alias("has_source")), "stem", "left")
    )
    out = rows.select(
        "stem",
        (F.col("conversion").isNull() & F.col("has_md").isNotNull()).alias("conversion_missing"),
        (F.col("downloaded_at").isNull() & F.col("has_source").isNotNull()).alias("download_missing"),
    )
    return out.where("conversion_missing OR download_missing")


def path_drift(catalog: DataFrame, markdown: DataFrame) -> DataFrame:
    """Rows whose markdown path isn't where the file is."""
    rows = catalog.select("stem", F.coalesce("markdown_path", F.lit("")).alias("stale_path")).join(markdown_of(markdown), "stem")
    return rows.where("stale_path <> key").select("stem", "stale_path", F.col("key").alias("resolved_path"))


def stuck_convert(catalog: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows never converted whose source is there."""
    return catalog.where("conversion IS NULL").select("stem").join(sources_of(papers), "stem")


def repair_plan(catalog: DataFrame, papers: DataFrame, markdown: DataFrame) -> DataFrame:
    """(direction, stem, detail) of all six directions, from one state of the tables.

    Each table is read once: the three are joined in full by stem, and a stem's row gives
    the directions that hold for it.
    """
    state = (
        catalog.select("stem", "conversion", "downloaded_at", F.coalesce("markdown_path", F.lit("")).alias("path"), F.lit(True).alias("known"))
        .join(sources_of(papers), "stem", "full")
        .join(markdown_of(markdown), "stem", "full")
    )
    known, source, file = F.col("known").isNotNull(), F.col("source_ext").isNotNull(), F.col("key").isNotNull()
    converted, failed = F.col("conversion").isNotNull(), F.coalesce("conversion.failed", F.lit(False))
    no_stamp, no_download = ~converted & file, F.col("downloaded_at").isNull() & source
    none = F.lit(None).cast("string")
    found = [
        ("disk_no_catalog", source & ~known, F.col("source_ext")),
        ("catalog_no_markdown", known & converted & ~failed & ~file, none),
        ("catalog_no_source", known & ~source & ~file, none),
        ("flag_drift", known & ~failed & (no_stamp | no_download), F.concat_ws(",", F.when(no_stamp, "conversion"), F.when(no_download, "download"))),
        ("path_drift", known & file & (F.col("path") != F.col("key")), F.col("key")),
        ("stuck_convert", known & ~converted & source, F.col("source_ext")),
    ]
    due = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("direction"), detail.alias("detail"))) for name, when, detail in found]))
    return state.select("stem", F.explode(due).alias("d")).select("d.direction", "stem", "d.detail")


def reconcile(markdown: DataFrame, indexed: DataFrame, catalog: DataFrame) -> DataFrame:
    """stem, class of every markdown file: ok, stamp_missing or embed_missing.

    A failed conversion and a skip that isn't a failed embedding are meant, so they are ok.
    """
    rows = (
        markdown_of(markdown)
        .select("stem")
        .join(indexed.select(F.col("doc_id").alias("stem"), F.lit(True).alias("in_index")).distinct(), "stem", "left")
        .join(catalog.select("stem", "embedding", "embedding_skip", F.col("conversion.failed").alias("failed")), "stem", "left")
    )
    meant = F.coalesce("failed", F.lit(False)) | F.coalesce(~F.startswith(F.col("embedding_skip.reason"), F.lit("embed_failed")), F.lit(False))
    found = F.col("in_index").isNotNull()
    return rows.select("stem", F.when(found & F.col("embedding").isNotNull(), "ok").when(found, "stamp_missing").when(meant, "ok").otherwise("embed_missing").alias("class"))


def index_orphans(indexed: DataFrame, markdown: DataFrame) -> DataFrame:
    """Indexed documents without a markdown file."""
    return indexed.select(F.col("doc_id").alias("stem")).distinct().join(markdown_of(markdown), "stem", "left_anti")


def encoded_twins(catalog: DataFrame) -> DataFrame:
    """Rows whose stem, percent-decoded, is another row's stem."""
    decoded = catalog.select("stem", percent_decoded("stem").alias("twin")).where("twin <> stem")
    return decoded.join(catalog.select(F.col("stem").alias("twin")), "twin", "left_semi").select("stem", "twin")


def listing(catalog: DataFrame, embedded: bool | None = None) -> DataFrame:
    """Stages of every row as booleans, optionally of embedded or other rows only."""
    done = F.coalesce(F.col("embedding.chunks_indexed") > 0, F.lit(False))
    rows = catalog if embedded is None else catalog.where(done == F.lit(embedded))
    return rows.select(
        "stem",
        F.col("downloaded_at").isNotNull().alias("downloaded"),
        F.col("conversion").isNotNull().alias("converted"),
        F.coalesce("conversion.failed", F.lit(False)).alias("conversion_failed"),
        done.alias("embedded"),
        F.col("embedding_skip").isNotNull().alias("embed_skipped"),
        F.col("repair").isNotNull().alias("repaired"),
    )


def embed_candidates(catalog: DataFrame, retry_skipped: bool = False) -> DataFrame:
    """Converted rows that are neither embedded nor, unless retried, skipped."""
    rows = catalog.where("conversion IS NOT NULL AND NOT coalesce(conversion.failed, false) AND embedding IS NULL")
    return (rows if retry_skipped else rows.where("embedding_skip IS NULL")).select("stem")


def title_candidates(catalog: DataFrame) -> DataFrame:
    """Rows with an identifier and without a title."""
    return catalog.where((F.coalesce(trimmed("doi"), F.lit("")) != "") & (F.coalesce(trimmed("title"), F.lit("")) == "")).select("stem", "doi")


def catalog_backfill(catalog: DataFrame, markdown: DataFrame) -> DataFrame:
    """Markdown files without a catalog row, with the key they belong under."""
    return markdown_of(markdown).join(catalog.select("stem"), "stem", "left_anti").select("stem", "key", sharded_key("stem", "md", "markdown").alias("sharded_key"))


def stems(objects: DataFrame) -> DataFrame:
    """The stems of a catalog that is kept as one YAML file a row."""
    return file_parts(objects).where("ext = 'yaml'").select("stem")


def delete(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    """The catalog without the rows of some stems."""
    return catalog.join(gone.select("stem").distinct(), "stem", "left_anti")


def repair_samples(plan: DataFrame, most: int = 10) -> DataFrame:
    """The first rows of each direction of a repair plan by stem, with their number n from 1."""
    by = Window.partitionBy("direction").orderBy("stem")
    return plan.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)


def reconcile_actions(classes: DataFrame, fix_stamps: bool = True, reembed: bool = True) -> DataFrame:
    """(stem, action) of reconcile's rows: fix_stamp for what is indexed without a stamp, reembed for what isn't indexed."""
    action = F.when(F.lit(fix_stamps) & (F.col("class") == "stamp_missing"), "fix_stamp").when(F.lit(reembed) & (F.col("class") == "embed_missing"), "reembed")
    return classes.select("stem", action.alias("action")).where("action IS NOT NULL")


def fixed_stamps(catalog: DataFrame, actions: DataFrame, chunks: DataFrame, at) -> DataFrame:
    """The catalog with an embedding stamp for each fix_stamp action, by the chunks (doc_id, n_chunks) that the index has."""
    due = actions.where("action = 'fix_stamp'").select("stem").join(chunks.select(F.col("doc_id").alias("stem"), F.col("n_chunks").alias("_n")), "stem")
    stamp = F.struct(at.alias("embedded_at"), F.lit("reconcile").alias("server"), F.col("_n").cast("long").alias("chunks_indexed"), F.lit(None).cast("string").alias("compute_device"))
    rows = catalog.join(due, "stem", "left")
    return rows.withColumn("embedding", F.when(F.col("_n") > 0, stamp).otherwise(F.col("embedding"))).select(*catalog.columns)


def upsert(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog with rows replaced or added by stem."""
    return catalog.join(rows.select("stem"), "stem", "left_anti").unionByName(rows)
