"""Interleaved document sequences: HTML into ordered text and media references, digests joined to payloads.

A media reference is an ``img`` (or ``source``, ``video``, ``audio``) whose ``src`` is ``sha256:<hex>``; its caption is the
``figcaption`` of its figure, or else its ``alt`` text. A page's parts come out of the
parser together; from there on sequences are in long form, one row per position, and are never gathered again.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import frugal, join_spread, scratch_path, stored

ROW = 24
UNIT = ROW * ROW
_PARTS = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_BREAKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol nav table tr td th br figure figcaption blockquote pre body title".split())
_HIDDEN = frozenset(("script", "style"))
_MEDIA = frozenset(("img", "source", "video", "audio"))


class _Parser(HTMLParser):
    """Ordered parts of one page: texts between block tags, media at their places."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.figure: list[int] = []
        self.in_figure = self.in_caption = False
        self.hidden = 0

    def end_text(self) -> None:
        text = "".join(self.words).strip(" \t\n\r\x0b\x0c")
        self.words.clear()
        if not text:
            return
        if self.in_caption and self.figure:
            for i in self.figure:
                self.parts[i]["caption"] = text
        else:
            self.parts.append({"position": len(self.parts), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BREAKS:
            self.end_text()
        if tag == "figure":
            self.in_figure, self.figure = True, []
        elif tag == "figcaption":
            self.in_caption = True
        elif tag in _MEDIA:
            at = dict(attrs)
            src = at.get("src") or ""
            if src:
                self.end_text()
                if self.in_figure:
                    self.figure.append(len(self.parts))
                digest = src[7:].lower() if src.startswith("sha256:") else None
                self.parts.append({"position": len(self.parts), "kind": "media", "text": None, "digest": digest, "caption": at.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in _BREAKS:
            self.end_text()
        if tag == "figcaption":
            self.in_caption = False
        elif tag == "figure":
            self.in_figure, self.figure = False, []

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)


def parse_parts(html: str | None) -> list[dict]:
    """The parts of one page; null and empty pages have none."""
    parser = _Parser()
    parser.feed(html or "")
    parser.close()
    parser.end_text()
    return parser.parts


def interleaved(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, kind, text, digest, caption): one row per text or media part, in page order.

    Unclosed tags end at the page's end, script and style are left out, a media tag without ``src`` is no part,
    one with another ``src`` than a digest keeps its place with a null digest. Repeated rows repeat their parts.
    """

    cut = pages.select(F.col(key).alias("key"), page_parts(F.col(html)).alias("parts"))
    return cut.select("key", F.inline("parts")).withColumnRenamed("key", key)


def page_parts(html: Column) -> Column:
    """The parts of each page as an array in page order."""

    @F.pandas_udf(PARTS)
    def parts(texts):
        return texts.map(parse_parts)

    return parts(html)


def interleaved_media(pages: DataFrame, store: DataFrame, key: str, html: str) -> DataFrame:
    """:func:`interleaved` with what the media store (digest, media) knows of every reference, in any order of rows.

    Texts keep their positions and have nulls there; so have references to digests that aren't in the store, or whose
    file doesn't have the digest it is filed under.
    """
    return resolve_media(stored(interleaved(pages, key, html), "parts"), media_features(store))


def pgm(text: Column) -> Column:
    """The UTF-8 bytes of ``text`` (null: empty) as a grey picture ``ROW`` pixels wide, one byte per pixel.

    The bytes are filled up with 255 to a positive multiple of ``UNIT``; the picture is a binary PGM file, which
    holds its samples unchanged.
    """
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    fill = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    head = F.concat(F.lit(f"P5\n{ROW} "), ((n + fill) / ROW).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "UTF-8"), raw, F.unhex(F.repeat(F.lit("FF"), fill.cast("int"))))


def pgm_samples(media: Column) -> Column:
    """The sample bytes of a picture written by :func:`pgm`."""
    head = F.decode(F.substring(media, 1, 32), "ISO-8859-1")
    return F.substring(media, F.length(F.regexp_extract(head, r"^P5\n\d+ \d+\n255\n", 0)) + 1, 2_147_483_647)


def _feature(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    entropy = float(-(p * np.log2(p)).sum())
    rows = x.reshape(-1, ROW)
    grid = np.add.reduceat(np.add.reduceat(rows.astype(np.int64), np.arange(0, ROW, 3), axis=1), np.arange(8) * (len(rows) // 8), axis=0)
    bits = "".join(map(str, (grid[:, 1:] > grid[:, :-1]).astype(int).ravel()))
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};dhash={int(bits, 2):014x}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([_feature(x.as_py()) for x in batch.column("samples")], pa.string())], names=[*batch.schema.names[:-1], "feature"])


def store_media(docs: DataFrame, text: str, path: str) -> None:
    """Writes every text's picture to ``path`` under its digest; one file row per row of ``docs``, copies included."""
    media = docs.select(pgm(F.col(text)).alias("media"))
    media.select(F.sha2("media", 256).alias("digest"), "media").write.option("compression", "zstd").parquet(path)


def media_features(store: DataFrame) -> DataFrame:
    """One row per digest of a media store: sizes, digests of samples and file, checksum of the end, features, ``uses``.

    ``uses`` is how often the store has it.

    Copies are computed where they lie and met by partial aggregation, so no payload is shuffled. A stored
    file whose digest isn't the one it is filed under is left out: its references then resolve to nulls.
    """
    samples = store.where(F.sha2("media", 256) == F.col("digest")).withColumn("samples", pgm_samples(F.col("media")))
    small = samples.select("digest", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "samples")
    featured = small.mapInArrow(frugal(_features), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return featured.groupBy("digest").agg(*[F.first(c).alias(c) for c in featured.columns[1:]], F.count("*").alias("uses"))


def resolve_media(parts: DataFrame, features: DataFrame) -> DataFrame:
    """Parts with what the media store knows of their digests; texts and unknown digests keep nulls.

    Texts don't take part in the join. A digest that many parts refer to is joined where they lie.
    """
    media, rest = parts.where("digest is not null"), parts.where("digest is null")
    uses = media.groupBy("digest").agg(F.count("*").alias("uses"))
    known = stored(features.drop("uses").join(uses, "digest"), "features")
    met = join_spread(media, known, "digest", "uses", "left")
    return met.unionByName(rest, allowMissingColumns=True)


def document_page(text: Column, caption: Column) -> Column:
    """A page of a document: its lines as paragraphs, then the figure that refers to its stored picture."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.concat(F.lit("<p>"), F.replace(esc(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(pgm(text), 256), F.lit('"><figcaption>'), esc(F.coalesce(caption, F.lit("unknown"))), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), lines, figure, F.lit("</article>"))


def document_media(docs: DataFrame, key: str = "doc_id", text: str = "text", caption: str = "source") -> DataFrame:
    """Each document's text stored as a picture, referred to from its page, and resolved by digest.

    Returns (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, n_texts,
    caption), one row per row of ``docs``, all but n_bytes read back from the stored files. A null text is empty and has one unit
    of filling; null keys and repeated rows stay as they are, an empty table gives an empty one. Each document's page, its lines
    and the figure that refers to its picture, is cut into its sequence of parts: ``position`` is the picture's place in it,
    ``n_texts`` the number of its texts. Texts of any length stay in one row. Columns of ``docs`` other than key, text and caption
    aren't read, so their names may clash with any here.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    store_media(docs, text, path)
    features = media_features(spark.read.schema("digest string, media binary").parquet(path))
    pages = docs.select(F.col(key).alias("key"), F.octet_length(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).cast("long").alias("n_bytes"), document_page(F.col(text), F.col(caption)).alias("html"))

    cut = pages.select("key", "n_bytes", page_parts(F.col("html")).alias("parts"))
    media = F.filter("parts", lambda p: p["kind"] == "media")
    refs = stored(cut.select("key", "n_bytes", (F.size("parts") - F.size(media)).alias("n_texts"), F.inline(media)).drop("kind", "text"), "references")
    out = resolve_media(refs, features)
    return out.select(F.col("key").alias(key), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_texts", "caption")
