"""Parsers over stored responses of search services: a table (url, status, body) in, hit rows out.

A response that is missing or can't be read gives the status "unavailable", never zero hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags

# How long excerpts are, and how many are kept
SNIPPET, HIGHLIGHTS, HITS = 240, 3, 15
#: Volumes that one query may be fanned out to.
MOST_VOLUMES = 1000


def _exploded(df: DataFrame, schema: str, path: str, most: int | None = None, items=None, **own: str) -> DataFrame:
    """(url, status, ord, hit) and the response's own fields by name: a row for each hit, made by ``items`` of the parsed response if that is given.

    What a response has once is taken out before its hits become rows: these would carry the whole of it otherwise."""
    df = df.withColumn("j", F.from_json(F.ltrim(F.col("body"), F.lit("﻿")), schema))
    hits = items(F.col("j")) if items else F.col(f"j.{path}")
    status = F.when(F.col("j").isNull() | F.col(f"j.{path}").isNull(), "unavailable").otherwise("ok")
    df = df.select("url", status.alias("status"), *(F.col(f"j.{c}").alias(name) for name, c in own.items()), (F.slice(hits, 1, most) if most else hits).alias("hits"))
    return df.select("url", "status", *own, F.posexplode_outer("hits").alias("ord", "hit"))


def volumes(df: DataFrame) -> DataFrame:
    """Book search: up to 15 hits of title (120), authors, year (4), id, snippet."""
    info = "struct<title:string,authors:array<string>,publishedDate:string>"
    got = _exploded(df, f"items array<struct<id:string,volumeInfo:{info},searchInfo:struct<textSnippet:string>>>", "items", HITS)
    return got.select("url", "status", "ord", F.substring("hit.volumeInfo.title", 1, 120).alias("title"), F.array_join("hit.volumeInfo.authors", "; ").alias("authors"), F.substring("hit.volumeInfo.publishedDate", 1, 4).alias("year"), F.col("hit.id").alias("id"), strip_tags(F.col("hit.searchInfo.textSnippet")).alias("snippet"))


def full_text(df: DataFrame) -> DataFrame:
    """Archive full text: up to 15 hits, three highlights of each."""
    got = _exploded(df, "hits array<struct<identifier:string,title:string,highlight:array<string>>>", "hits", HITS)
    return got.select("url", "status", "ord", F.col("hit.identifier").alias("id"), F.col("hit.title").alias("title"), F.slice(F.coalesce("hit.highlight", F.array()), 1, HIGHLIGHTS).alias("highlights"))


def corpus_hits(df: DataFrame) -> DataFrame:
    """XML hit lists: total, and author, work, year, text (400) of each hit."""
    inner = lambda tag: strip_tags(F.regexp_extract("block", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<hit\b[^>]*>(.*?)</hit>"), F.lit(1))
    total = F.regexp_extract("body", r'total="?>?(\d+)', 1)
    got = df.withColumn("total", F.when(total != "", total.cast("int"))).select("url", "total", F.posexplode_outer(blocks).alias("ord", "block"))
    return got.select("url", F.when(F.col("total").isNull(), "unavailable").otherwise("ok").alias("status"), "total", "ord", inner("author").alias("author"), inner("work").alias("work"), inner("year").alias("year"), F.substring(inner("text"), 1, 400).alias("text"))


def digitised(df: DataFrame) -> DataFrame:
    """Result lists: total, documents, up to three snippets without tags (240)."""
    got = _exploded(df, "total int, docs array<struct<id:string,title:string,snippets:array<string>>>", "docs", total="total")
    cut = F.transform(F.slice(F.coalesce("hit.snippets", F.array()), 1, HIGHLIGHTS), lambda s: F.substring(strip_tags(s), 1, SNIPPET))
    return got.select("url", "status", "total", "ord", F.col("hit.id").alias("id"), F.col("hit.title").alias("title"), cut.alias("snippets"))


def portal(df: DataFrame) -> DataFrame:
    """Manuscript portal: objects with their digitisation and up to two highlighted passages of each field."""
    schema = "objects array<struct<id:string,label:string,descriptions:array<string>>>, digitized map<string,string>, highlighting map<string,map<string,array<string>>>"

    def passages(j: Column, hit: Column) -> Column:
        own = F.filter(F.transform(F.concat(F.array(hit["id"]), F.coalesce(hit["descriptions"], F.array())), lambda i: F.try_element_at(j["highlighting"], i)), lambda m: m.isNotNull())
        return F.flatten(F.transform(own, lambda m: F.flatten(F.transform(F.map_values(m), lambda xs: F.slice(xs, 1, 2)))))

    found = lambda j: F.transform(j["objects"], lambda hit: F.struct(hit["id"].alias("id"), hit["label"].alias("label"), F.try_element_at(j["digitized"], hit["id"]).alias("digitized"), passages(j, hit).alias("parts")))
    got = _exploded(df, schema, "objects", items=found)
    return got.select("url", "status", "ord", "hit.id", "hit.label", "hit.digitized", F.transform(F.coalesce("hit.parts", F.array()), lambda x: strip_tags(x)).alias("passages"))


def keyword_in_context(df: DataFrame) -> DataFrame:
    """Corpus service: hits with their document's title."""
    schema = "hits array<struct<docPid:string,left:array<string>,match:array<string>,right:array<string>>>, docInfos map<string,struct<title:string>>"
    got = _exploded(df, schema, "hits", documents="docInfos")
    return got.select("url", "status", "ord", F.try_element_at(F.col("documents"), F.col("hit.docPid"))["title"].alias("title"), *(F.array_join(f"hit.{c}", " ").alias(c) for c in ("left", "match", "right")))


def within_volume(df: DataFrame) -> DataFrame:
    got = _exploded(df, "search_results array<struct<page_number:string,snippet_text:string>>", "search_results")
    return got.select("url", "status", "ord", F.col("hit.page_number").alias("page"), strip_tags(F.col("hit.snippet_text")).alias("snippet"))


def chants(df: DataFrame) -> DataFrame:
    """Concordance JSON: a row for each source of a chant."""
    fields = ("siglum", "folio", "feast", "office", "genre", "db", "century", "fulltext", "incipit", "chantlink", "srclink")
    got = _exploded(df, "chants array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>", "chants")
    return got.select("url", "status", "ord", "hit.*") if "hit" in got.columns else got


def _listed(df: DataFrame, item: str) -> DataFrame:
    """Responses whose body is a bare JSON list."""
    body = F.when(F.trim("body") != "", F.concat(F.lit('{"items":'), F.ltrim(F.col("body"), F.lit("\ufeff")), F.lit("}")))
    return _exploded(df.withColumn("body", body), f"items array<{item}>", "items")


def text_hits(df: DataFrame, genre: str | None = None) -> DataFrame:
    """Chants found by their words: id, genre and full text; of one genre if that is named."""
    got = _listed(df, "struct<cid:string,genre:string,fulltext:string>").select("url", "status", "ord", "hit.*")
    return got.where((F.col("status") != "ok") | (F.col("genre") == genre)) if genre else got


def next_chants(df: DataFrame) -> DataFrame:
    """Chants that follow a chant, as the service counts them: id, count, genre, feast and trimmed full text."""
    info = "struct<field_genre:string,field_feast:string,field_full_text:string>"
    got = _listed(df, f"struct<cid:string,count:bigint,info:{info}>")
    return got.select("url", "status", "ord", "hit.cid", F.col("hit.count").alias("n"), F.col("hit.info.field_genre").alias("genre"), F.col("hit.info.field_feast").alias("feast"), F.trim(F.coalesce("hit.info.field_full_text", F.lit(""))).alias("fulltext"))


def in_source_order(rows: DataFrame) -> DataFrame:
    """Concordance rows by century (none: last) and siglum."""
    return rows.orderBy(F.coalesce(F.nullif(F.col("century"), F.lit("")), F.lit("99")), F.coalesce("siglum", F.lit("")))


def database_chants(df: DataFrame, site: str) -> DataFrame:
    """The nine fields of each row of a chant database's page: siglum, folio, incipit, full text, feast, service, genre, id, link."""
    body = F.regexp_extract("body", r"(?s)<tbody(.*?)</tbody>", 1)
    got = df.select("url", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("ord", "row"))
    got = got.withColumn("raw", F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))).where(F.size("raw") >= 8)
    cell = lambda k: strip_tags(F.col("raw")[k])
    link = F.regexp_extract(F.col("raw")[2], r'(?s)href="(/chant/\d+/)"', 1)
    named = strip_tags(F.regexp_extract(F.col("raw")[2], r'(?s)href="/chant/\d+/"[^>]*>(.*?)</a>', 1))
    full = strip_tags(F.regexp_extract(F.col("raw")[2], r"(?s)<div>(.*?)</div>", 1))
    return got.select(
        "url", "ord", cell(0).alias("siglum"), cell(1).alias("folio"), F.when(link != "", named).otherwise(cell(2)).alias("incipit"), full.alias("fulltext"), cell(3).alias("feast"), cell(4).alias("service"),
        cell(5).alias("genre"), cell(7).alias("cid"), F.when(link != "", F.concat(F.lit(site), link)).otherwise("").alias("link"),
    )


def record_links(df: DataFrame, site: str) -> DataFrame:
    """(id, descriptions, files): what a record's page (id, body) links of its own, as whole addresses, in page order, each once."""
    whole = lambda found: F.array_distinct(F.transform(found, lambda x: F.when(F.startswith(x, F.lit("http")), x).otherwise(F.concat(F.lit(site), x))))
    host = f"(?:{site})?".replace(".", "[.]")
    ours = F.regexp_extract_all("body", F.concat(F.lit(f'href="({host}/description/'), F.col("id"), F.lit('/[0-9]+)"')), F.lit(1))
    files = F.regexp_extract_all("body", F.concat(F.lit(f"({host}/uploads/[^\"'\\s<>]*"), F.col("id"), F.lit("/[^\"'\\s<>]+)")), F.lit(1))
    return df.select("id", whole(ours).alias("descriptions"), whole(files).alias("files"))


def heading_links(df: DataFrame, own: str) -> DataFrame:
    """Heading (200) and the distinct links in order that don't lead into the catalogue itself (``own``)."""
    heading = F.substring(strip_tags(F.regexp_extract("body", r"(?s)<h1[^>]*>(.*?)</h1>", 1)), 1, 200)
    found = F.array_distinct(F.regexp_extract_all("body", F.lit(r'href="(https?://[^"]+)"'), F.lit(1)))
    return df.select("url", heading.alias("heading"), F.filter(found, lambda x: ~F.contains(x, F.lit(own))).alias("links"))


def table_rows(df: DataFrame, least: int = 8) -> DataFrame:
    """Cells of the rows of a page's table body; rows with fewer cells are skipped."""
    body = F.regexp_extract("body", r"(?s)<tbody(.*?)</tbody>", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))
    got = df.select("url", F.posexplode_outer(rows).alias("ord", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: strip_tags(x))
    return got.withColumn("cells", cells).where(F.size("cells") >= least).drop("row")


def melody_rows(df: DataFrame) -> DataFrame:
    """(url, status, reported, returned, truncated, ord, cells): a page with another layout is unavailable, not empty."""
    reported = F.regexp_extract("body", r"(?i)(\d+)\s+(?:results?|melod)", 1)
    rows = F.regexp_extract_all("body", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    got = df.withColumn("reported", F.when(reported != "", reported.cast("int"))).withColumn("rows", F.filter(rows, lambda r: F.contains(r, F.lit("<td"))))
    got = got.withColumn("status", F.when(F.col("body").isNull() | F.col("reported").isNull() | ((F.col("reported") > 0) & (F.size("rows") == 0)), "unavailable").otherwise("ok"))
    got = got.withColumns({"returned": F.size("rows"), "truncated": F.size("rows") < F.col("reported")})
    out = got.select("url", "status", "reported", "returned", "truncated", F.posexplode_outer("rows").alias("ord", "row"))
    return out.withColumn("cells", F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: strip_tags(x))).drop("row")


def result_blocks(df: DataFrame, ident: str = r"^F-[a-z0-9]{4}$") -> DataFrame:
    """Search pages: a row for each result block that carries an id."""
    blocks = F.slice(F.split("body", '<div class="search-result row">'), 2, 1_000_000)
    got = df.select("url", F.posexplode(blocks).alias("ord", "block"))
    every = lambda p: F.transform(F.regexp_extract_all("block", F.lit("(?s)" + p), F.lit(1)), lambda x: strip_tags(x))
    one = lambda p: F.regexp_extract("block", "(?s)" + p, 1)
    titles, head = every('<div class="document-title">(.*?)</div>'), strip_tags(one('<div class="document-headline">(.*?)</div>'))
    last = F.trim(F.element_at(F.split(head, "·"), -1))
    out = got.select(
        "url", "ord", F.try_element_at(F.filter(titles, lambda t: F.regexp_like(t, F.lit(ident))), F.lit(1)).alias("id"), F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit("")).alias("title"),
        strip_tags(one('<p class="serif[^"]*">(.*?)</p>')).alias("shelfmark"), head.alias("headline"), F.when(F.contains(last, F.lit("mm")), last).otherwise("").alias("dimensions_mm"),
        one(r"Online Since: ([\d/]+)").alias("online_since"), every('<span class="found-in">Found in: (.*?)</span>').alias("found_in"), F.coalesce(F.try_element_at(every('<span class="search-result-snippet">(.*?)</span>'), F.lit(1)), F.lit("")).alias("snippet"),
    )
    return out.where("id is not null").withColumn("title", F.when(F.col("title") == F.col("id"), "").otherwise(F.col("title")))


# Hosts whose image service, not the image's address, is what tiles are asked of
SERVICE_HOSTS = ("adore.ugent.be", "libcatalog.ugent.be")


def canvases(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Image manifests, version 2 or 3: a row for each canvas with label, image base and size.

    The base is the image's address up to /full/, else its service, else the address; hosts of SERVICE_HOSTS are asked by service. A canvas without a
    size has that of its base in ``known`` (base, w, h), if there is one."""
    v2 = "sequences array<struct<canvases:array<struct<label:string,width:int,height:int,images:array<struct<resource:struct<`@id`:string,service:struct<`@id`:string>>>>>>>>"
    v3 = "items array<struct<label:map<string,array<string>>,width:int,height:int,items:array<struct<items:array<struct<body:struct<id:string,service:array<struct<id:string>>>>>>>>>"
    both = df.withColumns({"a": F.from_json("body", v2), "b": F.from_json("body", v3)})

    def flat(label: Column, address: Column, service: Column, c: Column) -> Column:
        hosted = F.lit(False)
        for h in SERVICE_HOSTS:
            hosted = hosted | F.coalesce(F.contains(address, F.lit(h)), F.lit(False))
        cut = F.substring_index(address, "/full/", 1)
        base = F.when(hosted & service.isNotNull(), service).when(F.contains(address, F.lit("/full/")), cut).otherwise(F.coalesce(service, address))
        return F.struct(label.alias("label"), base.alias("base"), c["width"].alias("width"), c["height"].alias("height"))

    old = F.transform(F.col("a.sequences")[0]["canvases"], lambda c: flat(c["label"], c["images"][0]["resource"]["@id"], c["images"][0]["resource"]["service"]["@id"], c))
    body = lambda c: c["items"][0]["items"][0]["body"]
    new = F.transform(F.col("b.items"), lambda c: flat(F.element_at(F.map_values(c["label"]), 1)[0], body(c)["id"], body(c)["service"][0]["id"], c))
    out = both.select("url", F.posexplode_outer(F.coalesce(old, new)).alias("ord", "c")).select("url", "ord", "c.*")
    if known is None:
        return out
    met = out.join(known.select("base", "w", "h"), "base", "left")
    whole = (F.col("width") > 0) & (F.col("height") > 0)
    pick = lambda own, other: F.when(F.coalesce(whole, F.lit(False)), F.col(own)).otherwise(F.col(other)).alias(own)
    return met.select("url", "ord", "label", "base", pick("width", "w"), pick("height", "h"))


def volume_fan(queries: DataFrame, volumes_: DataFrame, responses: DataFrame) -> DataFrame:
    """Every query against every volume, volumes in order; where no response is stored the hits are unavailable. More than MOST_VOLUMES are refused, so what is sent out is bounded."""
    if volumes_.limit(MOST_VOLUMES + 1).count() > MOST_VOLUMES:
        raise ValueError(f"more than {MOST_VOLUMES} volumes")
    pairs = queries.crossJoin(F.broadcast(volumes_))
    return pairs.join(responses, ["query", "volume"], "left").withColumn("status", F.when(F.col("body").isNull(), "unavailable").otherwise("ok"))


def scan_source(df: DataFrame) -> DataFrame:
    """(id, text) of stored OCR scans (url, body): the id is the address' last part before _djvu.txt; pages, short texts and other names are left out."""
    ident = F.regexp_extract("url", r"([A-Za-z0-9][A-Za-z0-9._-]*)_djvu\.txt$", 1)
    return df.where((ident != "") & usable_scan(F.col("body"))).select(ident.alias("id"), F.col("body").alias("text"))


def usable_scan(body: Column, least: int = 1000) -> Column:
    """OCR texts: not a web page, and not too short."""
    return (F.length(body) > least) & ~F.regexp_like(F.substring(body, 1, 500), F.lit(r"(?i)<\s*(html|!doctype)"))


def receipt_violations(df: DataFrame) -> DataFrame:
    """Stored responses (url, body, sha256) that can't be replayed: without body, without receipt, or changed since."""
    sha = F.sha2(F.encode("body", "UTF-8"), 256)
    rule = F.when(F.col("body").isNull(), "no body").when(F.col("sha256").isNull(), "no receipt").when(sha != F.col("sha256"), "changed")
    return df.select("url", rule.alias("rule")).where("rule is not null")
