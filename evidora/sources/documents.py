"""Document sources: Markdown, OCR and PDF files, with their tables of contents."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normal_heading

DOCUMENT = "id string, path string, title string, mime string, combined_md string, toc string"
#: Mime types by source.
MIMES = {"md": "text/markdown", "pdf": "application/pdf", "ocr": "application/pdf"}
LEAST_PDF_CHARS = 200
#: Fixed value: the largest file that is ingested.
LARGEST_FILE = 100 * 1024 * 1024


class SourceError(ValueError):
    """A document that can't be read as its source says."""


class ServerError(RuntimeError):
    """An embedder's answer that its server failed (a status of 500 or above): worth another try."""


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, folder, stem, kind) of the Markdown and PDF files below ``path``; a missing path is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[mM][dD],[pP][dD][fF],[jJ][sS][oO][nN]}").load(path)
    large = F.when(F.col("length") > LARGEST_FILE, F.raise_error(F.concat(F.col("path"), F.lit(" is larger than 100 MB")))).otherwise(F.col("path"))
    files = files.select(large.alias("path"), "content")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.substring_index("path", "/", -1)
    return files.withColumns({"folder": F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)))"), "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "kind": F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))}).withColumn("name", folder)


def route(mode: str, kind: str) -> str:
    """The source for a file: as asked for, or by its extension."""
    if mode == "auto":
        if kind not in ("md", "pdf"):
            raise SourceError(f"no source for .{kind} files")
        return kind
    if mode not in ("md", "ocr", "pdf"):
        raise SourceError(f"unknown mode {mode}")
    return mode


def with_toc(files: DataFrame) -> DataFrame:
    """Add ``toc`` text to Markdown files: <stem>_toc.json beside it, or toc.json where it is the folder's only one."""
    md, js = files.filter("kind = 'md'"), files.filter("kind = 'json'").select("folder", "name", F.decode("content", "UTF-8").alias("toc"))
    md = md.withColumn("in_folder", F.count("*").over(W.partitionBy("folder")))
    own = js.select("folder", F.col("name").alias("own_name"), F.col("toc").alias("own"))
    rows = md.withColumn("own_name", F.concat("stem", F.lit("_toc.json"))).join(own, ["folder", "own_name"], "left")
    rows = rows.join(js.filter("name = 'toc.json'").select("folder", F.col("toc").alias("shared")), "folder", "left")
    return rows.withColumn("toc", F.coalesce("own", F.when(F.col("in_folder") == 1, F.col("shared")))).drop("own", "shared", "own_name", "in_folder")


def load_toc(raw: str) -> dict:
    """A validated table of contents {document_title, entries}; a bare list is taken as the legacy form.

    Entries of one key whose pages overlap are kept with a warning: which heading each takes is then left to order.
    """
    data = json.loads(raw)
    if isinstance(data, list):
        title, entries = None, upgrade_legacy(data)
    elif not isinstance(data, dict):
        raise SourceError("a table of contents is an object or a list")
    elif data.get("schema_version") != 1:
        raise SourceError(f"unsupported schema_version {data.get('schema_version')!r}")
    elif "entries" not in data:
        raise SourceError("entries are missing")
    else:
        title, entries = data.get("document_title"), list(data["entries"])
    ids = [e["id"] for e in entries]
    known = set(ids)
    if len(known) != len(ids):
        raise SourceError("repeated entry ids")
    keyed: dict[str, list[dict]] = {}
    for e in entries:
        match = e.get("match") or {}
        key = match.get("normalized_key", "")
        if (e.get("title_path") or [None])[-1] != e.get("title", ""):
            raise SourceError(f"title_path of {e['id']} does not end with its title")
        if (int(e["level"]) > 1 and e.get("parent_id") is not None and e["parent_id"] not in known) or not known.issuperset(e.get("children") or []):
            raise SourceError(f"{e['id']} names an unknown entry")
        if key != normal_heading(match.get("heading_text", "")):
            raise SourceError(f"normalized_key of {e['id']} disagrees with its heading")
        if e.get("page_start") is not None and e.get("page_end") is not None:
            keyed.setdefault(key, []).append(e)
    for key, own in keyed.items():
        own = sorted(own, key=lambda e: e["page_start"])
        last = None
        for e in own:
            if last is not None and e["page_start"] <= last["page_end"]:
                warnings.warn(f"entries {last['id']} and {e['id']} share the key {key!r} and pages", stacklevel=2)
            last = e if last is None or e["page_end"] > last["page_end"] else last
    return {"document_title": title, "entries": entries}


def upgrade_legacy(rows: list[dict]) -> list[dict]:
    """Entries with ids, parents, title paths and keys from {level, title, page} in order."""
    from .chunking import NUMBERED

    out: list[dict] = []
    stack: list[dict] = []
    for k, row in enumerate(rows):
        level, title = int(row["level"]), str(row["title"])
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        parent, number = (stack[-1] if stack else None), NUMBERED.fullmatch(title)
        e = {
            "id": f"legacy-{k}", "level": level, "number": number and number[1], "title": title, "title_path": [*(x["title"] for x in stack), title],
            "page_start": row.get("page"), "page_end": row.get("page"), "parent_id": parent and parent["id"], "children": [],
            "match": {"heading_text": title, "normalized_key": normal_heading(title), "strategy": "exact_normalized"},
        }
        if parent:
            parent["children"].append(e["id"])
        stack.append(e)
        out.append(e)
    return out


def toc_from_headings(md: str) -> list[dict]:
    """Provisional {level, title, page}; without title paths, so that chunking goes by headings."""
    from .chunking import NUMBERED, parse_blocks

    page, out = None, []
    for b in parse_blocks(md):
        page = b.page if b.kind == "page" else page
        if b.kind == "heading":
            m = NUMBERED.fullmatch(b.title)
            out.append({"level": m[1].count(".") + 1 if m else b.level, "title": b.title, "page": page})
    return out


def markdown_documents(files: DataFrame) -> DataFrame:
    """Documents from Markdown files with ``toc`` text; the title is the contents', the first heading's or the file's."""

    def run(frames):
        for frame in frames:
            rows = []
            for f in frame.itertuples():
                md = bytes(f.content).decode("utf-8")
                toc = load_toc(f.toc) if isinstance(f.toc, str) else None
                head = re.search(r"^#\s+(.+?)\s*#*\s*$", md, re.M)
                title = (toc or {}).get("document_title") or (head[1] if head else f.stem)
                entries = toc["entries"] if toc else toc_from_headings(md)
                rows.append((f.id, f.path, title, MIMES["md"], md, json.dumps(entries)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENT.split(", ")])

    return files.select(F.sha2("content", 256).alias("id"), "path", "stem", "content", "toc").mapInPandas(run, DOCUMENT)


def parsed_documents(files: DataFrame, parse: Callable[[bytes], dict], mime: str) -> DataFrame:
    """Documents from an injected parser of file bytes that gives {combined_md, toc}: an OCR client, for one."""

    def run(frames):
        for frame in frames:
            rows = []
            for f in frame.itertuples():
                got = parse(bytes(f.content))
                rows.append((f.id, f.path, f.stem, mime, got["combined_md"], json.dumps(got.get("toc") or [])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENT.split(", ")])

    return files.select(F.sha2("content", 256).alias("id"), "path", "stem", "content").mapInPandas(run, DOCUMENT)


def pdf_pages(pages: Callable[[bytes], list[str]]) -> Callable[[bytes], dict]:
    """A parser from one that gives the text of each page; too little text is an error."""

    def parse(content: bytes) -> dict:
        texts = pages(content)
        if sum(len(t.strip()) for t in texts) < LEAST_PDF_CHARS:
            raise SourceError("too little text; use OCR")
        return {"combined_md": "".join(f"<!-- page: {i} -->\n\n{t}\n\n" for i, t in enumerate(texts, 1)), "toc": []}

    return parse


def documents(spark: SparkSession, path: str, mode: str = "auto", ocr: Callable | None = None, pdf: Callable | None = None) -> DataFrame:
    """All documents below a path, each by the source that ``mode`` routes it to."""
    files = scan(spark, path)
    out = spark.createDataFrame([], DOCUMENT)
    for kind in [r["kind"] for r in files.select("kind").distinct().collect() if r["kind"] != "json"]:
        own, source = files.filter(F.col("kind") == kind), route(mode, kind)
        if source == "md":
            more = markdown_documents(with_toc(files.filter(F.col("kind").isin(kind, "json"))))
        else:
            parser = ocr if source == "ocr" else pdf and pdf_pages(pdf)
            if parser is None:
                raise SourceError(f"no parser was given for {source} files")
            more = parsed_documents(own, parser, MIMES[source])
        out = out.unionByName(more)
    return out


def embedded(rows: DataFrame, embed: Callable[[list[str]], list], dim: int, batch: int = 32, tries: int = 3) -> DataFrame:
    """Add ``embedding`` to rows with ``text`` by an injected embedder, in batches; wrong sizes are an error."""

    def run(frames):
        for frame in frames:
            out: list = []
            for lo in range(0, len(frame), batch):
                texts = frame["text"].iloc[lo : lo + batch].tolist()
                for k in range(tries):
                    try:
                        vectors = embed(texts)
                        break
                    except (ConnectionError, TimeoutError, ServerError):
                        if k + 1 == tries:
                            raise
                if any(len(v) != dim for v in vectors):
                    raise ValueError(f"embeddings must have {dim} dimensions")
                out += [[float(x) for x in v] for v in vectors]
            yield frame.drop(columns="embedding", errors="ignore").assign(embedding=out)

    kept = rows.drop("embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, schema + ", embedding array<float>")
