"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

`parse` reads HTML into ordered items: text, and media references (image, audio, video) with the caption that belongs to
them. `interleave` makes one row per item; positions count text and media together, so order and captions stay aligned.
Payloads are stored as 8-bit greyscale PNG images of WIDTH samples a row, named by digest: a task stores a payload once, as
long as it has met fewer than SEEN others since, so several tasks may store equal copies, of which `media_features` takes
one. `resolve` joins references with what was read back from the stored bytes; only digests and small columns are shuffled
there. References that very many items share, or that are null, are looked up without a shuffle.

Null and empty texts have an empty payload, stored as one padded row. Null HTML gives no items. References without a stored
payload keep nulls. Repeated rows each have their row; ids may be null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_list, tidy, written

WIDTH, PAD = 576, 255
#: Digests that a task remembers as stored.
SEEN = 200_000
#: Items of a reference that are dealt by it at most, and references above that which are broadcast at most.
COPIES, FEW = 1024, 1 << 16
MEDIA_TAGS = {"img": "image", "audio": "audio", "video": "video"}
SKIPPED = {"script", "style", "template"}
#: What may stand in a head without ending it, and which of them hold text.
HEAD, HEAD_TEXT = {"head", "title", "base", "link", "meta", "noscript"}, {"title", "noscript"}
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "figure", "figcaption", "br", "hr", "blockquote", "pre", "nav", "footer", "header", "main", "body", "html"}
ITEM = "struct<position:int, kind:string, text:string, ref:string, caption:string>"


class Interleaver(HTMLParser):
    """Collects items in document order; a figcaption goes to its figure's media, before or after it, alt text where there is none.

    A reference is the tag's src; without one, or where that holds its data itself, data-src; else the first of srcset; else
    the first of its source tags (of a picture: those before the image, of audio and video: those inside).

    Without its end tag, a head ends at the first tag or text that can't be in one, and a figcaption at the end of its figure or
    of the page. A figcaption that no media takes is a text item.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.buffer, self.skipping, self.figures, self.caption = [], [], 0, [], None
        self.head, self.inside = False, None
        self.picture, self.open = None, []

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        """The caption goes to the media that its figure has so far, or waits for the figure's end."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        start, waiting = self.figures[-1]
        if not self.give(start, text) and text:
            waiting.append((len(self.items), text))

    def give(self, start: int, text: str) -> bool:
        found = [item for item in self.items[start:] if item["kind"] != "text"]
        for item in found:
            item["caption"] = text or item["caption"]
        return bool(found)

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        start, waiting = self.figures.pop()
        for at, text in reversed(waiting):
            if not self.give(start, text):
                self.items.insert(at, {"kind": "text", "text": text, "ref": None, "caption": None})

    def end(self) -> None:
        while self.figures:
            self.end_figure()
        self.flush()

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
            return
        if tag == "head":
            self.head = True
        if self.head and not self.skipping:
            if tag in HEAD:
                self.inside = tag if tag in HEAD_TEXT else self.inside
                return
            self.head, self.inside = False, None
        if tag in BLOCKS or tag in MEDIA_TAGS:
            self.flush()
        if tag == "figure":
            self.figures.append((len(self.items), []))
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.caption = []
        elif tag == "picture":
            self.picture = ""
        elif tag == "source" and not self.skipping:
            ref = reference(dict(attrs))
            if self.open:
                self.open[-1]["ref"] = self.open[-1]["ref"] or ref
            elif self.picture is not None:
                self.picture = self.picture or ref
        elif tag in MEDIA_TAGS and not self.skipping:
            a = dict(attrs)
            item = {"kind": MEDIA_TAGS[tag], "text": None, "ref": reference(a) or (self.picture or None if tag == "img" else None), "caption": a.get("alt")}
            self.items.append(item)
            if tag != "img":
                self.open.append(item)

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)
            if tag in ("audio", "video"):
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag == "head":
            self.head, self.inside = False, None
        elif tag == self.inside:
            self.inside = None
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag == "picture":
            self.picture = None
        elif tag in ("audio", "video") and self.open:
            self.flush()
            self.open.pop()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.head and not self.skipping and not self.inside and data.strip():
            self.head = False
        if not self.skipping and not self.head:
            (self.buffer if self.caption is None else self.caption).append(data)


def reference(attrs: dict) -> str | None:
    src = attrs.get("src")
    if src and not src.startswith("data:"):
        return src
    first = (attrs.get("srcset") or attrs.get("data-srcset") or "").split()
    return attrs.get("data-src") or (first[0].rstrip(",") if first else None) or src or None


def parse(html: str | None) -> list[dict]:
    p = Interleaver()
    p.feed(html or "")
    p.close()
    p.end()
    return [{"position": k, **item} for k, item in enumerate(p.items)]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per page: id, the columns of `keep`, and `items`, the ordered array of ITEM."""
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    rows = pages.select(pages[html_col], pages[id_col], *[pages[c] for c in keep])

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 0)):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([parse(x) for x in b.column(0).to_pylist()], item)], [*b.schema.names[1:], "items"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(tidy(run), f"{schema}, items array<{ITEM}>")


def png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit greyscale image whose samples are the payload; its length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def png_samples(data: bytes) -> bytes:
    """The samples of an image that `png` stored. It checks every chunk's checksum, and that rows are unfiltered."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, width, height, body = 8, 0, 0, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    return data + bytes([PAD]) * (max(unit, -(-len(data) // unit) * unit) - len(data))


def feature(samples: bytes) -> str:
    """Mean, deviation and the shares of eight brightness ranges, in millionths."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    at, n = np.arange(256), len(x)
    mean = (counts * at).sum() / n
    dev = (max(0.0, (counts * at * at).sum() / n - mean * mean)) ** 0.5
    return ",".join([f"{mean:.6f}", f"{dev:.6f}", *(str(int(c * 1_000_000 // n)) for c in counts.reshape(8, 32).sum(axis=1))])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts as media: (id, n_bytes, html), an interleaved page that refers to the payload, and (ref, image), one row per
    distinct payload. Both come from one pass over the texts; a task stores a payload once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        seen = set()
        for b in (part for whole in batches for part in slices(whole, 1)):
            ids, n, pages, images, refs = b.column(0), [], [], [], []
            for i, x in zip(ids.to_pylist(), text_list(b.column(1)), strict=True):
                data = x.encode()
                payload = padded(data)
                key = hashlib.sha256(payload).digest()
                ref = f"sha256:{key.hex()}"
                n.append(len(data))
                pages.append(f'<article><p>document {escape(str(i))}</p><figure><img src="{ref}"><figcaption>{len(data)} bytes</figcaption></figure></article>')
                refs.append(ref)
                images.append(None if key in seen else png(payload))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(pages, pa.string()), pa.array(refs, pa.string()), pa.array(images, pa.binary())], ["id", "n_bytes", "html", "ref", "image"])

    made = written(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), f"id {kind}, n_bytes long, html string, ref string, image binary"), "media")
    return made.select(F.col("id").alias(id_col), "n_bytes", "html"), made.where("image is not null").select("ref", "image")


def media_features(media: DataFrame) -> DataFrame:
    """Per stored reference: what reading the stored bytes back gives. The bytes are not shuffled, only the results."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for ref, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = png_samples(image)
                out.append((ref, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["ref", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = media.mapInArrow(tidy(run), "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["ref"])


def resolve(pages: DataFrame, features: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per media item of every page: id, the columns of `keep`, position, caption, ref and its payload's columns (null
    if not stored)."""
    items = interleave(pages, id_col, html_col, keep).select(id_col, *keep, F.explode("items").alias("item")).where("item.kind <> 'text'")
    refs = written(items.select(id_col, *keep, "item.position", "item.caption", "item.ref"), "references")
    # fewer than FEW references can have more than a FEWth of all items
    shared = F.col("n") > max(COPIES, refs.count() // FEW)
    hot = F.broadcast(written(refs.groupBy("ref").agg(F.count("*").alias("n")).where(shared & F.col("ref").isNotNull()).select("ref"), "hot"))
    alone = F.col("ref").isNull()
    rest = refs.where(~alone).join(hot, "ref", "left_anti").join(features, "ref", "left")
    many = refs.where(~alone).join(hot, "ref", "left_semi").unionByName(refs.where(alone))
    return rest.unionByName(many.join(F.broadcast(features.join(hot, "ref", "left_semi")), "ref", "left"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, media = store_media(table(spark, sf_dir, "documents"))
    found = resolve(pages, written(media_features(media), "features"), "doc_id", keep=("n_bytes",))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
