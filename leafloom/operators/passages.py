"""Queries that readers ask: catalog, contents, passages, previews, curated quotes, redirects, structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plan_aids import once
from . import sections as S

#: Passages asked for that are broadcast; more of them are joined, each report in SALTS parts.
MAX_BROADCAST, SALTS = 500_000, 64


def catalog(registry: DataFrame) -> DataFrame:
    """(ord, id, title, byline) of the ingested reports in editorial order; a null flag means ingested."""
    kept = registry.filter(F.coalesce("ingested", F.lit(True)))
    return kept.select("ord", "id", "title", X.byline(F.col("authors"), F.col("published_at")).alias("byline")).orderBy("ord")


def overview(md: DataFrame, *, min_chars: int = 2500) -> DataFrame:
    """The contents of every document: its sections in order."""
    return S.sections(md, min_chars=min_chars)


def renamed(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """ids(id) with old ids replaced: (id, now_id, moved). aliases(old_id, new_id) is a small table, broadcast by its size."""
    j = ids.join(aliases, ids.id == aliases.old_id, "left")
    return j.select("id", F.coalesce("new_id", "id").alias("now_id"), F.col("new_id").isNotNull().alias("moved"))


def resolve(requests: DataFrame, para_sections: DataFrame) -> DataFrame:
    """requests(doc_id, para_id) -> (doc_id, para_id, slug, status): 302 to the section, 200 to the contents if unknown."""
    hits = para_sections.join(requests, ["doc_id", "para_id"], "left_semi")  # the few that are asked for, before anything moves
    j = requests.join(hits, ["doc_id", "para_id"], "left")
    return j.select("doc_id", "para_id", "slug", F.when(F.col("slug").isNull(), 200).otherwise(302).alias("status"))


def previews(paragraphs: DataFrame, cards: DataFrame) -> DataFrame:
    """(doc_id, para_id, quote, page, has_card) of paragraphs(doc_id, para_id, text, page)."""
    clean = X.trim_ws(F.regexp_replace(F.regexp_replace("text", r"\[\^[0-9]+\]", ""), f"{X.WS}+", " "))
    shown = once(paragraphs.select("doc_id", "para_id", "page", "text"), clean=clean)
    j = shown.join(cards.select("doc_id", "para_id", F.lit(True).alias("has")), ["doc_id", "para_id"], "left")
    return j.select("doc_id", "para_id", X.truncate(F.col("clean")).alias("quote"), "page", F.coalesce("has", F.lit(False)).alias("has_card"))


def card_quotes(quotes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Curated passages: by paragraph id, else the first paragraph of the report that holds the phrase.

    quotes: quote_id, report, paragraph, match_text, quote_text; paragraphs: report, doc_id, seq, para_id, text. Out:
    (quote_id, how, doc_id, para_id, quote, size); a passage found by neither way has nulls. The quotes of a report meet each
    of its paragraphs once, for both ways; of each quote only its first hits are kept where the paragraphs lie.
    """
    asked = quotes.select("quote_id", "report", "paragraph", F.nullif("match_text", F.lit("")).alias("phrase"))
    met = paragraphs.select("report", "doc_id", "seq", "para_id", "text").join(asked, "report")
    hit = F.struct("doc_id", "seq", "para_id", "text")
    named, holds = F.col("para_id") == F.col("paragraph"), F.contains("text", F.col("phrase"))
    hits = met.filter(named | holds).groupBy("quote_id").agg(F.min(F.when(named, hit)).alias("by_id"), F.min(F.when(holds, hit)).alias("by_phrase"))
    out = quotes.select("quote_id", "quote_text").join(hits, "quote_id", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_phrase").isNotNull(), "phrase").otherwise("none")
    first = F.coalesce("by_id", "by_phrase")
    out = out.select("quote_id", how.alias("how"), first["doc_id"].alias("doc_id"), first["para_id"].alias("para_id"), F.coalesce("quote_text", first["text"]).alias("text"))
    out = once(out, line=X.trim_ws(F.regexp_replace("text", f"{X.WS}+", " ")))
    out = once(out, quote=X.wrap_in_quotes(X.fit_to_card(F.col("line"))))
    return out.select("quote_id", "how", "doc_id", "para_id", "quote", X.card_size(F.length("quote")).alias("size"))


def card_manifest(cards: DataFrame) -> DataFrame:
    """One row: the sorted keys ``report/paragraph`` of the cards."""
    return cards.agg(F.sort_array(F.collect_set(F.concat_ws("/", "report", "paragraph"))).alias("keys"))


def sitemap(registry: DataFrame, secs: DataFrame, *, base: str = "https://reports.example") -> DataFrame:
    """(loc, priority): fixed pages, reports and sections. secs: id, sec_ord, slug."""
    spark = registry.sparkSession
    fixed = spark.createDataFrame([("/", 1.0), ("/reports", 0.9), ("/about", 0.5), ("/changelog", 0.3)], "path string, priority double")
    own = catalog(registry).select(F.concat(F.lit("/reports/"), "id").alias("path"), F.lit(0.8).alias("priority"))
    parts = secs.join(catalog(registry).select("id"), "id", "left_semi").select(F.concat(F.lit("/reports/"), "id", F.lit("/"), "slug").alias("path"), F.lit(0.6).alias("priority"))
    return fixed.unionByName(own).unionByName(parts).select(F.concat(F.lit(base.rstrip("/")), "path").alias("loc"), "priority").distinct()


def resolve_url(urls: DataFrame, prefixes: list[str], *, archive_base: str | None = None) -> DataFrame:
    """urls(url) -> (url, status, location): other hosts of the archive, ``www.``, and paths of the old site."""
    host, path = F.parse_url("url", F.lit("HOST")), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    query = F.coalesce(F.concat(F.lit("?"), F.parse_url("url", F.lit("QUERY"))), F.lit(""))
    old = F.lit(False)
    for p in prefixes:  # a fixed list of a few prefixes
        old = old | (path == p) | path.startswith(p + "/")
    scheme = F.concat(F.parse_url("url", F.lit("PROTOCOL")), F.lit("://"))
    archived = F.concat(F.lit((archive_base or "").rstrip("/")), path, query)
    status = F.when(host.isNull(), 400).when(host.startswith("old."), 503 if archive_base is None else 200).when(host.startswith("www."), 301).when(old, 301).otherwise(200)
    location = (
        F.when(host.startswith("old."), F.lit(None) if archive_base is None else archived)
        .when(host.startswith("www."), F.concat(scheme, F.substring(host, 5, 1000), path, query))
        .when(old, F.concat(scheme, F.lit("old."), host, path, query))
    )
    return urls.select("url", status.alias("status"), location.cast("string").alias("location"))


def json_ld(registry: DataFrame, *, base: str = "https://reports.example") -> DataFrame:
    """(id, report, breadcrumb): structured data; absent fields are left out."""

    def item(position: int, name: Column, url: Column) -> Column:
        return F.struct(F.lit("ListItem").alias("@type"), F.lit(position).alias("position"), name.alias("name"), url.alias("item"))

    url = F.concat(F.lit(base + "/reports/"), "id")
    report = F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("Report").alias("@type"), F.col("title").alias("name"), url.alias("url"),
            F.when(F.col("authors").isNotNull(), F.struct(F.lit("Organization").alias("@type"), F.col("authors").alias("name"))).alias("author"),
            F.col("published_at").alias("datePublished"), F.col("source_url").alias("isBasedOn"),
        )
    )
    crumbs = F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(item(1, F.lit("Reports"), F.lit(base + "/reports")), item(2, F.col("title"), url)).alias("itemListElement")))
    return registry.select("id", report.alias("report"), crumbs.alias("breadcrumb"))


def section(asked: DataFrame, secs: DataFrame) -> DataFrame:
    """asked(doc_id, slug) -> (doc_id, slug, status, i, n, title, prev, next, text): one section, 404 if there is none.

    A section whose slug is ``full`` is never found by it: that name stands for the whole document.
    """
    hits = secs.filter("slug <> 'full'").join(asked, ["doc_id", "slug"], "left_semi")
    j = asked.join(hits, ["doc_id", "slug"], "left")
    return j.select("doc_id", "slug", F.when(F.col("i").isNull(), 404).otherwise(200).alias("status"), "i", "n", "title", "prev", "next", "text")


def documents(md: DataFrame, asked: DataFrame, *, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, para_id, description, text): each document of a report for each passage that is asked of the report; the whole
    document, described by the passage if it has it. md: doc_id (a key), report, markdown; asked: report, para_id.

    What is asked meets a document in its own row, as one list per report, and rows are made from that list at the very end,
    since the pairs of documents and passages grow as the product of both: neither they nor the texts beside them are moved.
    """
    asked = asked.select("report", "para_id").filter(F.col("report").isNotNull()).distinct()
    names = asked.groupBy("report").agg(F.collect_list(F.struct("para_id")).alias("names"))  # a bare list would lose nulls
    names = names.select("report", F.col("names")["para_id"].alias("names"))
    small = asked.count() <= max_broadcast
    md = md.filter(F.col("doc_id").isNotNull() & F.col("report").isNotNull())
    if small:
        md = md.join(F.broadcast(names.select("report")), "report", "left_semi")
    docs = S.with_paragraphs(S.with_blocks(once(md, text=X.strip_front_matter(F.col("markdown"))))).select("doc_id", "report", "text", "paragraphs")
    if small:
        docs = docs.join(F.broadcast(names), "report")
    else:  # a hot report is split over SALTS tasks; a document moves once, before its rows are made
        names = names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("__salt", F.expr(f"pmod(xxhash64(doc_id), {SALTS})").cast("int")).join(names, ["report", "__salt"])
    clean = lambda t: X.trim_ws(F.regexp_replace(F.regexp_replace(t, r"\[\^[0-9]+\]", ""), f"{X.WS}+", " "))
    own = F.filter("paragraphs", lambda p: F.array_contains("names", p["para_id"]))
    docs = once(docs, own=F.transform(own, lambda p: F.struct(p["para_id"].alias("para_id"), clean(p["text"]).alias("clean"))))
    known = F.transform("own", lambda p: F.struct(p["para_id"].alias("para_id"), X.truncate(p["clean"]).alias("description")))
    unknown = F.transform(F.array_except("names", F.col("own")["para_id"]), lambda n: F.struct(n.alias("para_id"), F.lit(None).cast("string").alias("description")))
    return once(docs, rows=F.concat(known, unknown)).select("doc_id", "text", F.inline("rows")).select("doc_id", "para_id", "description", "text")
