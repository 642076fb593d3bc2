"""Bibliographic payloads of six providers as rows of one schema.

Each function takes a table with the payload as text and returns PAPERS' columns but
rank.  Payloads that can't be parsed give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import inverted_abstract, trimmed
from scholia.schemas import AUTHORS

COLUMNS = ["id", "title", "authors", "abstract_text", "publication_date", "doi", "download_urls", "cited_by_count", "source"]


def _author(name: Column, affiliations: Column | None = None) -> Column:
    return F.struct(F.coalesce(name, F.lit("")).alias("name"), (affiliations if affiliations is not None else F.array().cast("array<string>")).alias("affiliations"))


def _paper(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    default = {
        "title": F.lit(""), "authors": F.array().cast(AUTHORS), "abstract_text": F.lit(None).cast("string"), "publication_date": F.lit(None).cast("date"), "doi": F.lit(None).cast("string"),
        "download_urls": F.array().cast("array<string>"), "cited_by_count": F.lit(None).cast("bigint"),
    }
    row = default | columns | {"source": F.lit(source)}
    return df.select(*[row[c].alias(c) for c in COLUMNS])


def _known(*urls: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*urls)))


def _year(y: Column) -> Column:
    return F.when(y.between(1, 9999), F.make_date(y, F.lit(1), F.lit(1)))


def openalex(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Works; pdf urls of the best location, then of open access, then of all locations."""
    schema = (
        "id string, display_name string, doi string, publication_date string, cited_by_count bigint, abstract_inverted_index map<string,array<int>>, "
        "authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>, "
        "best_oa_location struct<pdf_url:string>, open_access struct<oa_url:string>, locations array<struct<pdf_url:string>>"
    )
    w = df.select(F.from_json(payload, schema).alias("w")).where("w.id IS NOT NULL").select("w.*")
    people = F.transform(F.coalesce("authorships", F.array().cast("array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>")), lambda a: _author(a["author"]["display_name"], F.array_compact(F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string>>")), lambda i: i["display_name"]))))
    rest = F.transform(F.coalesce("locations", F.array().cast("array<struct<pdf_url:string>>")), lambda x: x["pdf_url"])
    urls = F.array_distinct(F.array_compact(F.concat(F.array("best_oa_location.pdf_url", "open_access.oa_url"), rest)))
    index = F.col("abstract_inverted_index")
    return _paper(
        w, "openalex", id=F.regexp_replace("id", r"^https://openalex\.org/", ""), title=F.coalesce("display_name", F.lit("")), authors=people, abstract_text=F.when(F.size(index) > 0, inverted_abstract(index)),
        publication_date=F.col("publication_date").try_cast("date"), doi=F.regexp_replace("doi", r"^https://doi\.org/", ""), download_urls=urls, cited_by_count=F.col("cited_by_count"),
    )


def semantic_scholar(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Papers; the publisher's identifier, or one made of the arXiv id."""
    schema = "paperId string, title string, abstract string, year int, citationCount bigint, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string>, openAccessPdf struct<url:string>"
    w = df.select(F.from_json(payload, schema).alias("w")).where("w.paperId IS NOT NULL").select("w.*")
    doi = F.coalesce(F.nullif(F.trim("externalIds.DOI"), F.lit("")), F.concat(F.lit("10.48550/arXiv."), F.nullif(F.trim("externalIds.ArXiv"), F.lit(""))))
    people = F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: _author(a["name"]))
    return _paper(w, "semantic_scholar", id=F.col("paperId"), title=F.coalesce("title", F.lit("")), authors=people, abstract_text=F.col("abstract"), publication_date=_year(F.col("year")), doi=doi, download_urls=_known(F.col("openAccessPdf.url")), cited_by_count=F.col("citationCount"))


def europe_pmc(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Results; authors are one text, split at ', '."""
    schema = "id string, title string, authorString string, abstractText string, firstPublicationDate string, doi string, citedByCount bigint, fullTextUrlList struct<fullTextUrl:array<struct<documentStyle:string,url:string>>>"
    w = df.select(F.from_json(payload, schema).alias("w")).where("w.id IS NOT NULL").select("w.*")
    people = F.when(F.col("authorString").isNull(), F.array().cast(AUTHORS)).otherwise(F.transform(F.split(F.regexp_replace("authorString", r"\.$", ""), ", "), lambda a: _author(a)))
    urls = F.transform(F.filter(F.coalesce("fullTextUrlList.fullTextUrl", F.array().cast("array<struct<documentStyle:string,url:string>>")), lambda u: u["documentStyle"] == "pdf"), lambda u: u["url"])
    return _paper(w, "europe_pmc", id=F.col("id"), title=F.coalesce("title", F.lit("")), authors=people, abstract_text=F.col("abstractText"), publication_date=F.col("firstPublicationDate").try_cast("date"), doi=F.col("doi"), download_urls=F.array_distinct(F.array_compact(urls)), cited_by_count=F.col("citedByCount"))


def crossref(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Works; dates as parts, names as given and family, links of PDF type only."""
    schema = "DOI string, title array<string>, author array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>, abstract string, published struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` bigint, link array<struct<URL:string,`content-type`:string>>"
    w = df.select(F.from_json(payload, schema).alias("w")).where("w.DOI IS NOT NULL").select("w.*")
    name = lambda a: F.concat_ws(" ", a["given"], a["family"])
    people = F.transform(F.coalesce("author", F.array().cast("array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>")), lambda a: _author(name(a), F.array_compact(F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name:string>>")), lambda x: x["name"]))))
    parts = F.get(F.col("published.date-parts"), F.lit(0))
    y, m, d = (F.get(parts, F.lit(i)) for i in range(3))
    day = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(F.coalesce(m, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(d, F.lit(1)).cast("string"), 2, "0")).try_cast("date")
    links = F.transform(F.filter(F.coalesce("link", F.array().cast("array<struct<URL:string,`content-type`:string>>")), lambda x: x["content-type"] == "application/pdf"), lambda x: x["URL"])
    return _paper(w, "crossref", id=F.col("DOI"), title=F.coalesce(F.get("title", F.lit(0)), F.lit("")), authors=people, abstract_text=F.col("abstract"), publication_date=F.when(y.isNotNull(), day), doi=F.col("DOI"), download_urls=F.array_distinct(F.array_compact(links)), cited_by_count=F.col("is-referenced-by-count"))


def core(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Works; no citation counts."""
    schema = "id bigint, title string, abstract string, yearPublished int, doi string, authors array<struct<name:string>>, downloadUrl string"
    w = df.select(F.from_json(payload, schema).alias("w")).where("w.id IS NOT NULL").select("w.*")
    people = F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: _author(a["name"]))
    return _paper(w, "core", id=F.col("id").cast("string"), title=F.coalesce("title", F.lit("")), authors=people, abstract_text=F.col("abstract"), publication_date=_year(F.col("yearPublished")), doi=F.col("doi"), download_urls=_known(F.nullif("downloadUrl", F.lit(""))))


def arxiv(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Entries of Atom feeds; one payload may hold several."""
    schema = "struct<entry:array<struct<id:string,title:string,summary:string,published:string,doi:string,author:array<struct<name:string>>,link:array<struct<_title:string,_href:string>>>>>"
    plain = F.regexp_replace(F.col(payload), r"<(/?)[a-zA-Z]+:(doi\b)", "<$1$2")
    e = df.select(F.explode(F.from_xml(plain, schema, {"rowTag": "feed"})["entry"]).alias("e")).select("e.*")
    line = lambda c: trimmed(F.regexp_replace(F.col(c), r"\s+", " "))
    ident = F.regexp_replace(F.regexp_extract(F.trim("id"), r"abs/(.+)$", 1), r"v\d+$", "")
    people = F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: _author(a["name"]))
    urls = F.transform(F.filter(F.coalesce("link", F.array().cast("array<struct<_title:string,_href:string>>")), lambda x: x["_title"] == "pdf"), lambda x: x["_href"])
    return _paper(e, "arxiv", id=ident, title=F.coalesce(line("title"), F.lit("")), authors=people, abstract_text=line("summary"), publication_date=F.substring("published", 1, 10).try_cast("date"), doi=F.coalesce(F.col("doi"), F.concat(F.lit("10.48550/arXiv."), ident)), download_urls=F.array_compact(urls))


#: Names by which a provider may be asked for.
ALIASES = {
    "arxiv": "arxiv", "openalex": "openalex", "oa": "openalex", "semantic_scholar": "semantic_scholar", "semanticscholar": "semantic_scholar", "s2": "semantic_scholar",
    "europe_pmc": "europe_pmc", "europepmc": "europe_pmc", "pmc": "europe_pmc", "epmc": "europe_pmc", "crossref": "crossref", "core": "core",
}
MAPPERS = {"arxiv": arxiv, "openalex": openalex, "semantic_scholar": semantic_scholar, "europe_pmc": europe_pmc, "crossref": crossref, "core": core}


def provider(name: str):
    """The mapper of a provider's name or alias; ValueError for others."""
    try:
        return MAPPERS[ALIASES[name.strip().lower()]]
    except KeyError:
        raise ValueError(f"no provider: {name!r}") from None
