"""Records from stored payloads: feeds and JSON of literature services, files of several formats, result pages, manifests.

Payloads are what a fetch has stored (text, bytes or files); nothing here opens a connection.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from lectern.functions.text import arxiv_id, collapsed, first_year, html_text, paper_id, repaired, safe_name
from lectern.sources.stored import text_of_positions

# The longest text taken from an uploaded file, the longest abstract, the largest upload.
TEXT_CHARS, ABSTRACT_CHARS, UPLOAD_BYTES = 50_000, 900, 25 << 20
PAPER = ["paper_id", "source", "title", "authors", "abstract", "published_at", "doi", "arxiv_id", "url"]


def _known(c: Column) -> Column:
    return F.nullif(collapsed(c), F.lit(""))


def arxiv_papers(feeds: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of Atom feeds; entries without id or title are passed over."""
    entry = "struct<id string, title string, summary string, published string, author array<struct<name string>>>"
    d = feeds.select(F.explode(F.from_xml(F.col(column), f"entry array<{entry}>")["entry"]).alias("e"))
    own = arxiv_id(F.regexp_replace(collapsed(F.col("e.id")), "/+$", ""))
    d = d.select(own.alias("arxiv_id"), collapsed(F.col("e.title")).alias("title"), F.filter(F.transform("e.author", lambda a: collapsed(a["name"])), lambda n: n != "").alias("authors"), "e")
    d = d.where("coalesce(arxiv_id, '') <> '' and title <> ''")
    return d.select(
        paper_id(F.lit("arxiv"), F.col("arxiv_id")).alias("paper_id"), F.lit("arxiv").alias("source"), "title", "authors", collapsed(F.col("e.summary")).alias("abstract"),
        F.nullif(F.left(F.trim("e.published"), F.lit(10)), F.lit("")).alias("published_at"), F.lit(None).cast("string").alias("doi"), "arxiv_id", collapsed(F.col("e.id")).alias("url"),
    )


def openalex_papers(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of search answers in JSON; works without id or title are passed over. Adds is_oa, pdf_url and cited_by_count."""
    work = (
        "id string, title string, display_name string, doi string, publication_date string, authorships array<struct<author struct<display_name string>>>, abstract_inverted_index map<string, array<int>>, "
        "best_oa_location struct<pdf_url string, landing_page_url string>, open_access struct<is_oa boolean>, cited_by_count long"
    )
    d = payloads.select(F.explode(F.from_json(F.col(column), f"results array<struct<{work}>>")["results"]).alias("w"))
    doi, wid = _known(F.col("w.doi")), _known(F.col("w.id"))
    title = F.coalesce(_known(F.col("w.title")), _known(F.col("w.display_name")))
    stable = F.regexp_replace(F.coalesce(doi, F.element_at(F.split(F.rtrim(wid, F.lit("/")), "/"), -1)), "^https://doi\\.org/", "")
    names = F.filter(F.transform("w.authorships", lambda a: collapsed(a["author"]["display_name"])), lambda n: n != "")
    landing = _known(F.col("w.best_oa_location.landing_page_url"))
    return d.where(wid.isNotNull() & title.isNotNull()).select(
        paper_id(F.lit("openalex"), stable).alias("paper_id"), F.lit("openalex").alias("source"), title.alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.coalesce(collapsed(text_of_positions(F.col("w.abstract_inverted_index"))), F.lit("")).alias("abstract"), _known(F.col("w.publication_date")).alias("published_at"),
        F.when(doi.isNotNull(), stable).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.coalesce(doi, landing, wid).alias("url"),
        F.coalesce("w.open_access.is_oa", F.lit(False)).alias("is_oa"), _known(F.col("w.best_oa_location.pdf_url")).alias("pdf_url"), F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by_count"),
    )


def partial_date(*parts: Column) -> Column:
    """The first of several lists of year, month and day that isn't empty, as 2024, 2024-05 or 2024-05-01; else null."""
    some = F.coalesce(*[F.when(F.size(F.get(p, F.lit(0))) > 0, F.slice(F.get(p, F.lit(0)), 1, 3)) for p in parts])
    text = F.transform(some, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.when(F.length(x.cast("string")) < 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))))
    return F.when(some.isNotNull(), F.array_join(text, "-"))


def crossref_papers(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Papers of works and of search answers in JSON (message, or message.items); those without title or DOI are passed over."""
    date = "struct<`date-parts` array<array<int>>>"
    work = (
        f"DOI string, URL string, type string, title array<string>, abstract string, author array<struct<given string, family string>>, `is-referenced-by-count` long, "
        f"`published-print` {date}, `published-online` {date}, published {date}, issued {date}"
    )
    m = F.from_json(F.col(column), f"message struct<{work}, items array<struct<{work}>>>")["message"]
    fields = ["DOI", "URL", "type", "title", "abstract", "author", "is-referenced-by-count", "published-print", "published-online", "published", "issued"]
    one = lambda x: F.struct(*[x[f].alias(f) for f in fields])
    d = payloads.select(m.alias("m")).select(F.explode(F.coalesce(F.transform("m.items", one), F.array(one(F.col("m"))))).alias("w"))
    title, doi = _known(F.get("w.title", F.lit(0))), _known(F.col("w.DOI"))
    names = F.filter(F.transform("w.author", lambda a: collapsed(F.concat_ws(" ", _known(a["given"]), _known(a["family"])))), lambda n: n != "")
    parts = [F.col(f"w.`{k}`.`date-parts`") for k in ("published-print", "published-online", "published", "issued")]
    d = d.where(title.isNotNull() & doi.isNotNull())
    return d.select(
        paper_id(F.lit("doi"), doi).alias("paper_id"), F.lit("doi").alias("source"), title.alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.coalesce(html_text(F.col("w.abstract")), F.lit("")).alias("abstract"), partial_date(*parts).alias("published_at"), doi.alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
        F.coalesce(_known(F.col("w.URL")), F.concat(F.lit("https://doi.org/"), doi)).alias("url"), F.coalesce("w.`is-referenced-by-count`", F.lit(0)).alias("cited_by_count"),
    )


def synthetic_papers(spark: SparkSession, n: int, source: str, value: str, topic: str = "", author: str = "Research Group") -> DataFrame:
    """``n`` made-up papers that are the same at every call."""
    name = topic or value or "Research"
    i = F.col("id")
    stable = F.left(F.sha1(F.concat_ws(":", F.lit(source), F.lit(value), i.cast("string"))), F.lit(8))
    own = F.when(i == 0, F.lit(value)).otherwise(F.concat(F.lit(f"{value}-"), i.cast("string")))
    text = f"This paper discusses {name} with emphasis on reproducible pipelines, evaluation, and source-grounded academic writing. Ref "
    return spark.range(n).select(
        paper_id(F.lit(source), own).alias("paper_id"), F.lit(source).alias("source"), F.concat(F.lit(f"{name} Study "), (i + 1).cast("string")).alias("title"),
        F.array(F.lit(author)).alias("authors"), F.concat(F.lit(text), stable, F.lit(".")).alias("abstract"), F.format_string("202%d-01-01", i % 6).alias("published_at"),
        F.lit(value if source == "doi" else None).cast("string").alias("doi"), F.lit(value if source == "arxiv" else None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("url"), stable.alias("stable_hash"),
    )


# --- files ---------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, media_type, modified, length, content) of all files under ``path``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", suffix(F.col("path")).alias("suffix"), media_type(F.col("path")).alias("media_type"), F.col("modificationTime").alias("modified"), "length", "content")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.[^./]*$", 0))


def media_type(path: Column) -> Column:
    # Types of the suffixes that are read.
    kinds = {
        ".pdf": "application/pdf", ".md": "text/markdown; charset=utf-8", ".markdown": "text/markdown; charset=utf-8", ".txt": "text/plain; charset=utf-8", ".html": "text/html; charset=utf-8",
        ".htm": "text/html; charset=utf-8", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".json": "application/json", ".csv": "text/csv", ".xml": "application/xml",
    }
    out = F.lit("application/octet-stream")
    for k, v in kinds.items():
        out = F.when(suffix(path) == k, v).otherwise(out)
    return out


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraphs of a Word file, blank ones left out; empty for what can't be read."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(b) -> str:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(b)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return ""
        lines = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
        return "\n".join(x for x in lines if x.strip()).strip()

    return content.map(one)


@F.pandas_udf(StructType().add("pages", IntegerType()).add("text", StringType()))
def pdf_pages(content: pd.Series) -> pd.DataFrame:
    """Pages and text of PDF files where a reader is installed; no pages where it isn't, or can't read them."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return pd.DataFrame({"pages": [0] * len(content), "text": [""] * len(content)})

    def one(b):
        try:
            pages = PdfReader(io.BytesIO(b)).pages
            return len(pages), "\n".join(p.extract_text() or "" for p in pages).strip()
        except Exception:  # noqa: BLE001 - a reader fails in its own ways on broken files
            return 0, ""

    return pd.DataFrame([one(b) for b in content], columns=["pages", "text"])


def file_text(d: DataFrame, most: int = TEXT_CHARS) -> Column:
    """Text of ``d`` (suffix, content) by the kind of file, ``most`` characters of it (a limit of uploads); others have none."""
    plain = F.col("suffix").isin(".txt", ".md", ".markdown", ".html", ".htm")
    text = F.when(plain, F.make_valid_utf8(F.col("content").cast("string"))).when(F.col("suffix") == ".docx", docx_text("content")).when(F.col("suffix") == ".pdf", pdf_pages("content")["text"]).otherwise("")
    return F.left(text, F.lit(most))


def local_papers(found: DataFrame, tenant: str, user: str) -> DataFrame:
    """Papers of ``files``: title from the file's name, abstract from the head of the text. Larger files than an upload may be are left out."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    title = F.regexp_replace(name, "\\.[^.]*$", "")
    d = found.where(F.col("length") <= UPLOAD_BYTES).withColumn("full_text", file_text(found))
    source = F.regexp_replace("suffix", "^\\.", "")
    return d.select(
        F.concat_ws(":", F.lit("paper"), source, F.left(F.sha1(F.concat_ws(":", source, title)), F.lit(12))).alias("paper_id"), F.lit(tenant).alias("tenant_id"), F.lit(user).alias("user_id"), source.alias("source"),
        title.alias("title"), F.left("full_text", F.lit(ABSTRACT_CHARS)).alias("abstract"), "full_text", "media_type", F.concat(F.left(F.sha2("content", 256), F.lit(16)), F.lit("_"), safe_name(name)).alias("stored_name"),
    )


def author_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def distinct_content(found: DataFrame) -> DataFrame:
    """One of each content (that with the least path), with its digest and the name it is kept under."""
    d = found.withColumn("digest", F.sha2("content", 256))
    keep = d.groupBy("digest").agg(F.min("path").alias("path"))
    d = d.join(keep, ["digest", "path"], "left_semi")
    return d.withColumn("kept_as", F.concat(F.left("digest", F.lit(16)), F.lit("_"), safe_name(F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)?$", 1)), F.lit(".pdf")))


def pdf_problem(url: Column, content: Column, pages: Column, text: Column) -> Column:
    """Why a download is no article: placeholder, preview or no PDF; null where it is one."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")
    n = F.octet_length(content)
    # Texts of placeholder pages.
    return (
        F.when(F.lower(F.coalesce(url, F.lit(""))).contains("/ads/"), "PDF_PLACEHOLDER").when(F.coalesce(F.hex(F.substring(content, 1, 5)), F.lit("")) != "255044462D", "PDF_INVALID")
        .when(bare.isin("1/1绘制", "1/1", "绘制"), "PDF_PLACEHOLDER").when((pages == 1) & (n < 100 * 1024) & (F.char_length(bare) < 200), "PDF_INCOMPLETE")
    )


# --- result pages ----------------------------------------------------------------------------------------------------

# Parts of the addresses of results, and signs of pages that show none.
RESULT_URLS = ("/kcms2/article/abstract", "kcms/detail/detail.aspx", "kns8s/detail", "dbcode=", "filename=")
CHALLENGE, LOGIN, NOTHING = ("验证码", "安全验证", "访问过于频繁", "captcha"), ("请登录", "机构登录", "登录后", "login"), ("未检索到", "没有找到", "暂无数据", "0 条结果")
DOWNLOADS = ("PDF下载", "原版阅读", "CAJ下载", "HTML阅读")


def is_result_url(url: Column) -> Column:
    low = F.lower(F.coalesce(F.try_url_decode(url), url, F.lit("")))
    out = F.lit(False)
    for m in RESULT_URLS:
        out = out | low.contains(m)
    return out


def result_items(pages: DataFrame, key: str, html: str = "html", accept=is_result_url, limit: int = 20) -> DataFrame:
    """(key, position, title, detail_url, summary, year): links of stored result pages that ``accept`` takes, first of each
    address, ``limit`` a page. Title: the link's title or text; summary and year from its row or list item."""
    row = "(?is)<(?:tr|li)\\b.*?</(?:tr|li)>|<a\\b.*?</a>"
    d = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(row), 0)).alias("__row", "__box"))
    d = d.select(key, "__row", "__box", F.posexplode(F.regexp_extract_all("__box", F.lit("(?is)<a\\b.*?</a>"), 0)).alias("__a", "__link"))
    title = F.coalesce(F.nullif(F.regexp_extract("__link", '(?is)<a\\b[^>]*\\btitle="([^"]*)"', 1), F.lit("")), F.regexp_extract("__link", "(?is)^<a\\b[^>]*>(.*)</a>$", 1))
    d = d.withColumns({"title": repaired(html_text(title)), "detail_url": F.regexp_extract("__link", '(?is)<a\\b[^>]*\\bhref="([^"]*)"', 1), "__text": repaired(html_text(F.col("__box")))})
    d = d.where((F.char_length("title") >= 3) & (F.col("detail_url") != "")).where(accept(F.col("detail_url")))
    d = d.withColumns({"summary": F.left("__text", F.lit(500)), "year": first_year(F.col("__text"))})
    at = F.struct("__row", "__a")
    d = d.groupBy(key, "detail_url").agg(F.min(at).alias("__at"), F.min_by(F.struct("title", "summary", "year"), at).alias("r"))
    d = d.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("__at"))).where(F.col("position") <= limit)
    return d.select(key, "position", "r.title", "detail_url", "r.summary", "r.year")


def page_signs(text: Column) -> Column:
    """(challenge, login_required, explicit_empty) of a page's text."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def has(marks) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | low.contains(m)
        return out

    return F.struct(has(CHALLENGE).alias("challenge"), has(LOGIN).alias("login_required"), has(NOTHING).alias("explicit_empty"))


def download_order(candidates: DataFrame, key: str, keep: int = 6) -> DataFrame:
    """``candidates`` (key, index, text, href, visible) in the order in which to try them, from 1; advertisements are left out."""
    kind = F.lit(len(DOWNLOADS))
    for i, mark in reversed(list(enumerate(DOWNLOADS))):
        kind = F.when(F.coalesce("text", F.lit("")).contains(mark), i).otherwise(kind)
    d = candidates.where(F.col("visible") & ~F.lower(F.coalesce("href", F.lit(""))).contains("/ads/"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(kind, "index"))
    return d.withColumn("try", n).where(F.col("try") <= keep)


# --- other files -----------------------------------------------------------------------------------------------------


def legacy_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, user_id, paper_id, strokes, notes) of files annotations/tenant/user/name.json; files without paper are passed over."""
    stroke = "struct<page int, type string, color string, points array<array<double>>, content string>"
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.input_file_name().alias("f"), F.from_json("value", f"paper_id string, strokes array<{stroke}>, notes string").alias("r"))
    part = lambda i: F.regexp_extract("f", "/annotations/([^/]+)/([^/]+)/", i)
    d = d.select(part(1).alias("tenant_id"), part(2).alias("user_id"), "r.paper_id", F.coalesce("r.strokes", F.array().cast(f"array<{stroke}>")).alias("strokes"), F.coalesce("r.notes", F.lit("")).alias("notes"))
    return d.where("coalesce(paper_id, '') <> '' and tenant_id <> ''")


# How names, modules and entry points of skills are made.
SKILL_NAME, MODULE, ENTRY = "^[a-z][a-z0-9_]{1,63}$", "^skills\\.[a-zA-Z0-9_.]+$", "^[a-zA-Z_][a-zA-Z0-9_]*$"
_MANIFEST = StructType([StructField(c, StringType()) for c in ("name", "module", "entrypoint", "version", "description")] + [StructField("enabled", BooleanType())])
def _last_front(text: str) -> str | None:
    """What stands between the last two rules that open and close a block."""
    held, found = None, None
    for line in text.splitlines():
        if line != "---":
            held = None if held is None else [*held, line]
        elif held:
            held, found = None, "\n".join(held)
        else:
            held = []
    return found


@F.pandas_udf(_MANIFEST)
def front_matter(text: pd.Series) -> pd.DataFrame:
    """Fields of the last front matter of a manifest; nulls where there is none or it is no mapping."""
    names = ["name", "module", "entrypoint", "version", "description", "enabled"]

    def one(t) -> list:
        found = _last_front(t or "")
        try:
            m = (yaml.safe_load(found) or {}) if found is not None else None
        except yaml.YAMLError:
            m = None
        if not isinstance(m, dict):
            return [None] * 6
        default = {"entrypoint": "run_survey_workflow", "version": "0.1.0"}
        return [str(m.get(k) or default.get(k, "")).strip() for k in names[:5]] + [bool(m.get("enabled", True))]

    return pd.DataFrame([one(t) for t in text], columns=names)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length, name, module, entrypoint, version, description) of enabled, well-named skills at path/*/SKILL.md."""
    d = spark.read.format("binaryFile").load(f"{path}/*/SKILL.md").where(~F.col("path").rlike("/_[^/]*/SKILL\\.md$"))
    d = d.select("path", F.col("modificationTime").alias("modified"), "length", front_matter(F.col("content").cast("string")).alias("m")).select("path", "modified", "length", "m.*")
    return d.where(F.col("enabled") & F.col("name").rlike(SKILL_NAME) & F.col("module").rlike(MODULE) & F.col("entrypoint").rlike(ENTRY)).drop("enabled")


def candidate_manifest(name: Column, version: Column, description: Column, recipe_json: Column) -> Column:
    """A skill candidate as a manifest that isn't enabled."""
    head = F.concat(F.lit("---\nname: "), name, F.lit("\nversion: "), F.coalesce(version, F.lit("0.1.0-draft")), F.lit("\nenabled: false\ndescription: "), F.regexp_extract(F.to_json(F.array(F.coalesce(description, F.lit("")))), "^\\[(.*)\\]$", 1), F.lit("\n---\n\n"))
    return F.concat(head, F.lit("## Recipe\n\n```json\n"), recipe_json, F.lit("\n```\n"))


def write_candidates(candidates: DataFrame, path: str) -> None:
    """One text file row set a tenant: (tenant_id, manifest)."""
    candidates.select(safe_name(F.col("tenant_id"), "tenant", "a-zA-Z0-9_-", 80).alias("tenant_id"), F.col("manifest").alias("value")).write.mode("append").partitionBy("tenant_id").option("lineSep", "\n").text(path)
