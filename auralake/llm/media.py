"""Media columns: documents stored as baseline JPEG, read back, with dimensions and thumbnail hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.jpeg import average_hash, dc_planes, encode_payloads, pad_payload, parse
from auralake.llm.storage import id_long, id_text

#: Payload bytes that one numpy pass handles; a longer text makes a pass of its own.
PASS_BYTES = 1 << 20

_FIELDS = (
    "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, width int, height int, feature string"
)


def _describe(ids: list, raws: list[bytes], keep_media: bool) -> pd.DataFrame:
    stored = encode_payloads([pad_payload(r) for r in raws])
    images = [parse(m) for m in stored]
    planes = iter(dc_planes([i for of in images for i in of]))
    rows = []
    for doc_id, raw, media, of in zip(ids, raws, stored, images, strict=True):
        thumbs = [next(planes) for _ in of]
        payload = b"".join(t.tobytes() for t in thumbs)
        height = sum(i.height for i in of)
        feature = f"{of[0].width}x{height}:" + "-".join(average_hash(t) for t in thumbs)
        rows.append(
            (
                doc_id,
                len(raw),
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-32:]),
                len(media),
                hashlib.sha256(media).hexdigest(),
                of[0].width,
                height,
                feature,
                *([media] if keep_media else []),
            )
        )
    return pd.DataFrame(rows, columns=[*(f.split()[0] for f in _FIELDS.split(", ")), *(["media"] if keep_media else [])])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stored form and features of every row's text; with keep_media also the JPEG bytes (column media).

    The text's UTF-8 bytes (null: none), padded with 255 to a positive multiple
    of 576, become DC-only grey blocks; all columns but n_bytes come from
    decoding the stored bytes again, and the thumbnail is the payload itself.
    Texts beyond 196,416 bytes make several images, one below the other.  Equal
    texts give equal values; null and repeated ids pass through; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, raws, size = [], [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = (text or "").encode("utf-8")
                if raws and size + len(raw) > PASS_BYTES:
                    yield _describe(ids, raws, keep_media)
                    ids, raws, size = [], [], 0
                ids.append(doc_id)
                raws.append(raw)
                size += len(raw)
            if raws:
                yield _describe(ids, raws, keep_media)

    rows = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    return id_long(rows.mapInPandas(run, _FIELDS + (", media binary" if keep_media else "")))


def thumbnails(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, width, height, thumb_width, thumb_height, thumb, thumb_hash, error) of any baseline JPEG column.

    Only the first image of a value is read.  What is null, not baseline JPEG,
    cut off or at odds with itself gives nulls and the reason in `error`; no
    bytes make the task fail.  Dimensions beyond what the scan can hold are
    refused before memory is taken for them.  Null and repeated ids pass
    through; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, raw in zip(pdf["doc_id"], pdf["media"], strict=True):
                try:
                    image = parse(bytes(raw) if raw is not None else b"\0")[0]
                    (t,) = dc_planes([image])
                    rows.append((doc_id, image.width, image.height, t.shape[1], t.shape[0], t.tobytes(), average_hash(t), None))
                except Exception as e:  # noqa: BLE001 - the bytes may be anything
                    rows.append((doc_id, None, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "width", "height", "thumb_width", "thumb_height", "thumb", "thumb_hash", "error"])

    rows = media.select(id_text(id_col), F.col(media_col).alias("media"))
    return id_long(rows.mapInPandas(run, "doc_id string, width int, height int, thumb_width int, thumb_height int, thumb binary, thumb_hash string, error string"))
