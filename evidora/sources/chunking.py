"""Markdown to blocks, sections and chunks, document by document."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import normal_heading

#: The forms of lines, without the blanks around them.
PAGE = re.compile(r"<!--\s*page:?\s*(\d+)\s*-->", re.I)
HEADING = re.compile(r"(#{1,6})\s+(.*)")
FENCE = re.compile(r"`{3,}|~{3,}")
IMAGE = re.compile(r"!\[.*?\]\(.*?\)")
CAPTION = re.compile(r"(figure|fig\.)\s+\d", re.I)
NUMBERED = re.compile(r"(\d+(?:\.\d+)*)\s+(.+)")
CLOSERS = {r"\[": r"\]", "$$": "$$"}
#: Fixed value: no chunk takes a block beside its overlap beyond so many tokens, or 1.5 times the size.
HARD_LIMIT = 1500
TOKENS = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Block:
    kind: str
    start: int
    end: int
    level: int = 0
    title: str = ""
    page: int | None = None


@dataclass(frozen=True)
class Span:
    """A section: where it applies, how deep it is, and its path."""

    start: int
    end: int
    level: int
    path: str


def count_tokens(text: str) -> int:
    return len(TOKENS.findall(text))


def line_kind(line: str) -> str:
    """What a line without the blanks around it would begin."""
    if not line:
        return "blank"
    if PAGE.fullmatch(line):
        return "page"
    if HEADING.fullmatch(line):
        return "heading"
    if line in CLOSERS:
        return "math"
    if FENCE.match(line):
        return "code"
    if line.startswith("|"):
        return "table"
    return "image" if IMAGE.fullmatch(line) else "text"


def parse_blocks(md: str) -> list[Block]:
    """Blocks in order. Each begins where its first line does and ends with its last line.

    Maths lies between marks that have a line to themselves, and is prose where it isn't closed; a fence that isn't
    closed runs on to the end; a table is any run of lines that begin with a bar; an image takes the caption that
    follows, blank lines between, up to the next blank line; prose runs up to a blank line or the start of another kind.
    """
    lines = md.splitlines(keepends=True)
    at = list(itertools.accumulate(map(len, lines), initial=0))
    text = [x.strip() for x in lines]
    kinds = [line_kind(x) for x in text]
    n, i, out = len(lines), 0, []

    def run(k: int, goes_on: Callable[[int], bool]) -> int:
        while k < n and goes_on(k):
            k += 1
        return k

    while i < n:
        kind, end = kinds[i], i + 1
        if kind == "page":
            out.append(Block("page", at[i], at[end], page=int(PAGE.fullmatch(text[i])[1])))
        elif kind == "heading":
            m = HEADING.fullmatch(text[i])
            out.append(Block("heading", at[i], at[end], len(m[1]), m[2].strip()))
        elif kind == "code":
            mark = FENCE.match(text[i])[0]
            end = min(n, run(i + 1, lambda k: not text[k].startswith(mark)) + 1)
            out.append(Block("code", at[i], at[end]))
        elif kind == "table":
            end = run(i, lambda k: kinds[k] == "table")
            out.append(Block("table", at[i], at[end]))
        elif kind == "image":
            caption = run(i + 1, lambda k: not text[k])
            glued = caption < n and CAPTION.match(text[caption])
            end = run(caption, lambda k: text[k]) if glued else end
            out.append(Block("figure" if glued else "paragraph", at[i], at[end]))
        elif kind != "blank":
            closed = run(i + 1, lambda k: text[k] != CLOSERS[text[i]]) if kind == "math" else n
            if closed < n:
                end = closed + 1
                out.append(Block("math", at[i], at[end]))
            else:
                end = run(i + 1, lambda k: kinds[k] == "text")
                out.append(Block("paragraph", at[i], at[end]))
        i = end
    return out


def _ends(starts_and_levels: list[tuple[int, int]], length: int) -> list[int]:
    """Where each section ends: at the next one of its level or above. One pass."""
    ends, open_ = [length] * len(starts_and_levels), []
    for k, (start, level) in enumerate(starts_and_levels):
        while open_ and starts_and_levels[open_[-1]][1] >= level:
            ends[open_.pop()] = start
        open_.append(k)
    return ends


def heading_spans(blocks: list[Block], length: int) -> list[Span]:
    """Sections from headings: a numbered title's dots give its level, and its number isn't part of the path."""
    heads = []
    for b in blocks:
        if b.kind == "heading":
            m = NUMBERED.fullmatch(b.title)
            heads.append((b.start, m[1].count(".") + 1 if m else b.level, m[2] if m else b.title))
    out: list[Span] = []
    stack: list[tuple[int, str]] = []
    for (start, level, title), end in zip(heads, _ends([h[:2] for h in heads], length), strict=True):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        out.append(Span(start, end, level, "/".join(t for _, t in stack)))
    return out


def preorder(entries: list[dict]) -> list[dict]:
    """Entries in the order of their children lists; as they come if there are none."""
    by_id = {e["id"]: e for e in entries if e.get("id")}
    if not any(e.get("children") for e in entries):
        return entries
    inner = {c for e in entries for c in e.get("children") or []}
    out: list[dict] = []
    work = [e for e in reversed(entries) if e.get("id") not in inner]
    seen: set[int] = set()
    while work:
        e = work.pop()
        if id(e) in seen:
            continue
        seen.add(id(e))
        out.append(e)
        work += [by_id[c] for c in reversed(e.get("children") or []) if c in by_id]
    return out + [e for e in entries if id(e) not in seen]


def toc_spans(blocks: list[Block], entries: list[dict], length: int) -> list[Span]:
    """Sections from a table of contents: each entry takes the first unused heading that fits, by key within a page of
    its own, by key anywhere, or by the heading text it names; unmatched entries have no section."""
    pages, page = {}, None
    heads = []
    for b in blocks:
        page = b.page if b.kind == "page" else page
        if b.kind == "heading":
            heads.append(b)
            pages[b.start] = page
    keys = {b.start: normal_heading(b.title) for b in heads}
    used: set[int] = set()
    found: list[tuple[int, dict]] = []

    def take(fits: Callable[[Block], bool]) -> Block | None:
        return next((b for b in heads if b.start not in used and fits(b)), None)

    for e in preorder(entries):
        match = e.get("match") or {}
        key = match.get("normalized_key") or normal_heading(e.get("title") or "")
        first, last = e.get("page_start"), e.get("page_end") or e.get("page_start")
        near = lambda b: first is not None and pages[b.start] is not None and first - 1 <= pages[b.start] <= last + 1
        head = take(lambda b: keys[b.start] == key and near(b)) or take(lambda b: keys[b.start] == key)
        if head is None and match.get("heading_text"):
            wanted = normal_heading(match["heading_text"])
            head = take(lambda b: keys[b.start] == wanted)
        if head is not None:
            used.add(head.start)
            found.append((head.start, e))
    found.sort(key=lambda x: x[0])
    ends = _ends([(start, e["level"]) for start, e in found], length)
    return [Span(start, end, e["level"], "/".join(e.get("title_path") or [e["title"]])) for (start, e), end in zip(found, ends, strict=True)]


def deepest(spans: list[Span], points: list[int]) -> list[Span | None]:
    """The deepest section at each of the ascending points, the later one on ties. Each section is looked at once."""
    waiting = sorted(spans, key=lambda s: -s.start)
    open_: list[tuple[int, int, int, Span]] = []
    out = []
    for at in points:
        while waiting and waiting[-1].start <= at:
            s = waiting.pop()
            heapq.heappush(open_, (-s.level, -s.start, len(waiting), s))
        while open_ and open_[0][3].end <= at:
            heapq.heappop(open_)
        out.append(open_[0][3] if open_ else None)
    return out


def pack_blocks(md: str, blocks: list[Block], size: int, overlap: int, count: Callable[[str], int] = count_tokens) -> list[tuple[int, int]]:
    """Runs of blocks of about ``size`` tokens, as their first and last offsets.

    A run's last block, even its only one, opens the next run too if it has at most ``overlap`` tokens. Where nothing
    fits beside it, one more block is taken all the same, up to HARD_LIMIT or 1.5 times the size; a longer block makes
    a run of its own.
    """
    hard = min(HARD_LIMIT, max(size, size * 3 // 2))
    n = [count(md[b.start : b.end]) for b in blocks]
    out: list[tuple[int, int]] = []
    first = new = 0  # the run's first block, and its first that no run before it has
    while new < len(blocks):
        total, beyond = sum(n[first:new]), new
        while beyond < len(blocks) and (beyond == first or total + n[beyond] <= size):
            total += n[beyond]
            beyond += 1
        if beyond == new:
            if n[new] > hard:
                out.append((blocks[first].start, blocks[first].end))
                first = new
            beyond = new + 1
        out.append((blocks[first].start, blocks[beyond - 1].end))
        first = beyond - 1 if n[beyond - 1] <= min(overlap, hard) else beyond
        new = beyond
    return out


def chunk_document(doc_id: str, md: str, toc: list[dict] | None = None, size: int = 500, overlap: int = 50, count: Callable[[str], int] = count_tokens) -> list[dict]:
    """Chunks of one document: none crosses a section's border, each is a slice of the text."""
    blocks = parse_blocks(md)
    rich = bool(toc) and {"id", "title_path", "match"} <= set(toc[0])
    spans = toc_spans(blocks, toc, len(md)) if rich else []
    spans = spans or heading_spans(blocks, len(md))
    marks = [b.start for b in blocks if b.kind == "page"]
    pages = [b.page for b in blocks if b.kind == "page"]
    body = [b for b in blocks if b.kind != "page"]
    regions: list[tuple[str, list[Block]]] = []
    for b, section in zip(body, deepest(spans, [(b.start + b.end) // 2 for b in body]), strict=True):
        path = section.path if section else ""
        if regions and regions[-1][0] == path:
            regions[-1][1].append(b)
        else:
            regions.append((path, [b]))
    out = []
    for path, own in regions:
        for start, end in pack_blocks(md, own, size, overlap, count):
            text = md[start:end]
            if not text.strip():
                continue
            on = pages[max(0, bisect.bisect_right(marks, start) - 1) : bisect.bisect_left(marks, end)]
            out.append(
                {
                    "id": hashlib.sha256(f"{doc_id}|{start}|{end}".encode()).hexdigest(), "doc_id": doc_id, "text": text, "token_count": count(text),
                    "start_offset": start, "end_offset": end, "page_start": on[0] if on else None, "page_end": on[-1] if on else None,
                    "section_path": path, "content_hash": hashlib.sha256(text.encode()).hexdigest(), "position": len(out),
                }
            )
    return out


CHUNK = "id string, doc_id string, text string, token_count int, start_offset int, end_offset int, page_start int, page_end int, section_path string, content_hash string, position int"
COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]


def chunks(documents: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of documents (id, combined_md, toc), where toc is JSON text or null; each document by itself."""
    import json

    def run(frames):
        for frame in frames:
            rows = []
            for d in frame.itertuples():
                toc = json.loads(d.toc) if isinstance(d.toc, str) and d.toc else None
                rows += chunk_document(d.id, d.combined_md or "", toc, size, overlap)
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("page_start", "page_end"):
                out[c] = out[c].astype("Int32")
            yield out

    return documents.select("id", "combined_md", "toc").mapInPandas(run, CHUNK)


BLOCK = "id string, position int, kind string, start int, length int, level int, title string"


def blocks(documents: DataFrame) -> DataFrame:
    """(id, position, kind, start, length, level, title) of the blocks of documents (id, combined_md)."""

    def run(frames):
        for frame in frames:
            rows = [(d.id, k, b.kind, b.start, b.end - b.start, b.level, b.title) for d in frame.itertuples() for k, b in enumerate(parse_blocks(d.combined_md or ""))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK.split(", ")])

    return documents.select("id", "combined_md").mapInPandas(run, BLOCK)
