"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Each response gives two records. The metadata record (application/warc-fields) lists the source's HTTP
headers, title, language, size and links. The conversion record (text/plain) holds the visible text. Both
carry WARC-Refers-To (the response's identifier), the refers-to target and date, the source's payload
digest, and digests of their own blocks. Identifiers are UUIDs made from the response's identifier and
the kind of record, so a run again yields the same ones.

Responses are independent: no shuffle, and a task holds one Arrow batch of pages. Defined cases: a null
or empty payload gives a metadata record with size 0 and an empty conversion record; an unclosed
comment, script or style runs to the end, and a tag that nothing closes is text; a very long page is converted whole, in time
that grows in proportion to it, whether it is well formed or not; keys may not bear the name of a
record's field (an error says so); null urls stay null; repeated responses give repeated records; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import need

RESPONSE = "record_id string, target_uri string, date string, headers string, payload string"
RECORD = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_digest string, source_headers string, block string"

OPENS = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
CLOSES = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "head", "title")}
BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
BLANKS, SPACES, LINES = re.compile(r"\s+"), re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")
TITLE, HTML, ANCHOR = (re.compile(rf"<{k}\b", re.I) for k in ("title", "html", "a"))
LANG, LANG_VALUE = re.compile(r"\blang\s*=\s*", re.I), re.compile(r"[\"']?([A-Za-z-]+)")
HREF, HREF_VALUE = re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")


def without_hidden(page: str) -> str:
    """The page without comments, scripts, styles and the like; what is not closed runs to the end."""
    out, at, look, tags = [], 0, 0, True
    while m := OPENS.search(page, look):
        if m[1] is None:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            gt = page.find(">", m.end()) if tags else -1
            if gt < 0:  # no tag ends behind here
                tags, look = False, m.end()
                continue
            close = CLOSES[m[1].lower()].search(page, gt + 1)
            end = close.end() if close else len(page)
        out.append(page[at : m.start()])
        at = look = end
    return "".join([*out, page[at:]])


def _replaced(pattern: re.Pattern, by: str, s: str) -> str:
    """Tags replaced, looked for only where one can still end: each then ends at the next bracket, so none is read twice."""
    cut = s.rfind(">") + 1
    return pattern.sub(by, s[:cut]) + s[cut:]


def attributes(page: str, tag: re.Pattern, key: re.Pattern, value: re.Pattern) -> Iterator[re.Match]:
    """The value of the first such attribute in each such tag, tags and values in one pass over the page."""
    places = [(m.start(), m.end()) for m in key.finditer(page)]
    k = gt = done = 0
    for m in tag.finditer(page):
        if m.start() < done:
            continue
        if gt < m.end():
            gt = page.find(">", m.end())
            gt = len(page) if gt < 0 else gt
        while k < len(places) and places[k][0] < m.end():
            k += 1
        at = k
        while at < len(places) and places[at][0] <= gt:
            if found := value.match(page, places[at][1]):
                done = found.end()
                yield found
                break
            at += 1


def plain_text(page: str) -> str:
    """Visible text: a line for each block, blanks folded, entities decoded."""
    s = _replaced(TAG, "", _replaced(BLOCK, "\n", without_hidden(page)))
    return LINES.sub("\n", SPACES.sub(" ", entities.unescape(s))).strip()


def title_of(page: str) -> str | None:
    """What stands in the first title that is closed."""
    if m := TITLE.search(page):
        gt = page.find(">", m.end())
        close = CLOSES["title"].search(page, gt + 1) if gt >= 0 else None
        return page[gt + 1 : close.start()] if close else None
    return None


def metadata_block(page: str, headers: str) -> str:
    """The application/warc-fields lines of a response."""
    one = lambda s: BLANKS.sub(" ", entities.unescape(s)).strip()
    rows = [("http-header", one(h)) for h in headers.split("\r\n") if h.strip()]
    rows += [("title", one(t))] if (t := title_of(page)) is not None else []
    rows += [("language", m[1])] if (m := next(attributes(page, HTML, LANG, LANG_VALUE), None)) else []
    rows.append(("source-length", str(len(page.encode()))))
    rows += [("outlink", one(m[1] or m[2] or m[3] or "")) for m in attributes(page, ANCHOR, HREF, HREF_VALUE)]
    return "".join(f"{k}: {v}\r\n" for k, v in rows)


def digest(raw: bytes) -> str:
    return "sha256:" + hashlib.sha256(raw).hexdigest()


def derived_id(source: str | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def derive(responses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """responses(RESPONSE columns and keys) to records: keys and the RECORD columns."""
    names = [x.strip().split(" ")[0] for x in RESPONSE.split(",")]
    clash = {*keys} & {x.strip().split(" ")[0] for x in RECORD.split(",")}
    if clash:
        raise ValueError(f"keys named as fields of a record: {', '.join(sorted(clash))}")
    rows = need(responses, *keys, *names)
    out_names = [x.strip().split(" ")[0] for x in RECORD.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made, index = [], []
                for i, row in enumerate(part.select(names).to_pylist()):
                    page, headers = row["payload"] or "", row["headers"] or ""
                    source = digest(page.encode())
                    for kind, mime, block in (("metadata", "application/warc-fields", metadata_block(page, headers)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
                        raw = block.encode("utf-8", "replace")
                        made.append((derived_id(row["record_id"], kind), kind, row["record_id"], row["target_uri"], row["date"], mime, len(raw), digest(raw), source, headers, raw.decode()))
                        index.append(i)
                columns = list(zip(*made, strict=True)) or [()] * len(out_names)
                types = [pa.int64() if n == "content_length" else pa.string() for n in out_names]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)).take(pa.array(index, pa.int64())) for k in keys), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, *out_names])

    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema[k] for k in keys), *T._parse_datatype_string(RECORD).fields])
    return rows.mapInArrow(run, schema)


def responses_of_pages(pages: DataFrame, date: str, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Response records of a crawl table (page_id, url, html)."""
    rows = need(pages, *dict.fromkeys((*keys, "page_id", "url", "html")))
    h = F.sha1(F.concat_ws("\n", F.lit("response"), F.col("page_id").cast("string"), F.col("url")))
    part = lambda a, n: F.substring(h, a, n)
    ident = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size)
    return rows.select(*keys, ident.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), F.col("html").alias("payload"))


def warc_bytes() -> Column:
    """A derived record as it stands in a WARC file."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c), F.lit("")), F.lit("\r\n"))
    return F.encode(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Date", "date"), line("WARC-Target-URI", "target_uri"),
        line("WARC-Refers-To", "refers_to"), line("WARC-Refers-To-Target-URI", "target_uri"), line("WARC-Refers-To-Date", "date"), line("WARC-Block-Digest", "block_digest"),
        line("WARC-Source-Payload-Digest", "source_digest"), line("Content-Type", "content_type"), F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")), "UTF-8")


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a WARC file, plain or gzipped. A truncated last record is left out."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while (head := raw.find(b"\r\n\r\n", at)) >= 0:
        lines = raw[at:head].decode("utf-8", "replace").strip().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.get("content-length", "0")) if fields.get("content-length", "0").isdigit() else 0
        if not lines[0].startswith("WARC/") or head + 4 + size > len(raw):
            return
        yield fields, raw[head + 4 : head + 4 + size]
        at = head + 4 + size
        while raw[at : at + 2] == b"\r\n":
            at += 2


def read_responses(files: DataFrame, content: str = "content") -> DataFrame:
    """Response records of WARC files (binaryFile rows): a row each, the payload decoded as UTF-8."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                out = []
                for fields, block in parse_records(raw.as_py() or b""):
                    if fields.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        out.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode("latin-1"), body.decode("utf-8", "replace")))
                names = [x.strip().split(" ")[0] for x in RESPONSE.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [()] * 5)], names)

    return need(files, content).mapInArrow(run, RESPONSE)
