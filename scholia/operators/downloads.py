"""Where a paper's file may be had, and which fetched files are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import arxiv_id_of_doi
from scholia.operators.quality import is_html, is_paywall, is_pdf

_LOCATION = "struct<url_for_pdf:string,url_for_landing_page:string>"
UNPAYWALL = f"best_oa_location {_LOCATION}, oa_locations array<{_LOCATION}>"


def unpaywall_url(payload: Column) -> Column:
    """The best location's PDF, then any location's, then the best landing page."""
    p = F.from_json(payload, UNPAYWALL)
    any_pdf = F.get(F.filter(p["oa_locations"], lambda x: x["url_for_pdf"].isNotNull()), F.lit(0))["url_for_pdf"]
    return F.coalesce(p["best_oa_location"]["url_for_pdf"], any_pdf, p["best_oa_location"]["url_for_landing_page"])


def resolved(papers: DataFrame) -> DataFrame:
    """papers (doi, unpaywall, pmc_url, download_urls) with url and resolver: arXiv, Unpaywall, PMC, then the providers' urls."""
    arxiv = arxiv_id_of_doi("doi")
    found = [("arxiv", F.when(arxiv.isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv))), ("unpaywall", unpaywall_url(F.col("unpaywall"))), ("pmc", F.col("pmc_url")), ("provider", F.get("download_urls", F.lit(0)))]
    name = F.coalesce(*[F.when(url.isNotNull(), F.lit(n)) for n, url in found], F.lit("not_found"))
    return papers.withColumns({"url": F.coalesce(*[u for _, u in found]), "resolver": name})


def verified(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files (key, content) that aren't there yet, with sha256, size and outcome: stored, paywall or not_a_document."""
    new = files.join(existing.select("key"), "key", "left_anti")
    text = F.col("content").cast("string")
    outcome = F.when(is_pdf(F.col("content")), "stored").when(~is_html(text), "not_a_document").when(is_paywall(text), "paywall").otherwise("stored")
    return new.withColumns({"sha256": F.sha2("content", 256), "size_bytes": F.octet_length("content").cast("long"), "outcome": outcome})


def batch_report(results: DataFrame) -> DataFrame:
    """One row: succeeded, skipped and failed of results with an outcome."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return results.agg(n("stored").alias("succeeded"), n("skipped").alias("skipped"), n("paywall", "not_a_document", "not_found").alias("failed"))
