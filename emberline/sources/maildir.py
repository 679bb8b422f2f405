"""Maildir folders as a DataFrame of parsed messages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "message_id string, date timestamp, date_iso string, sender string, recipients array<string>, subject string, body string, in_reply_to string, references array<string>, folder_path string, raw_text string, body_hash string, dedup_key string"
_ID = re.compile(r"<([^>]+)>")


def _one(value: str | None) -> str:
    found = _ID.search(value or "")
    return found[1] if found else (value or "").strip()


def _body(message) -> str:
    for part in message.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            text = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
            if text:
                return text
    return ""


def parse_message(raw: bytes, folder: str) -> dict | None:
    """The fields of one message; None without a Message-ID."""
    message = message_from_bytes(raw, policy=policy.compat32)
    head = lambda k: str(message.get(k) or "")
    name = _one(head("Message-ID"))
    if not name:
        return None
    try:
        date = parsedate_to_datetime(head("Date"))
    except (TypeError, ValueError):
        date = None
    iso = date.isoformat() if date else None
    sender = next((a.lower() for _, a in getaddresses([head("From")]) if a), "")
    listed = [a.strip().lower() for k in ("To", "Cc", "Bcc") for _, a in getaddresses([head(k)]) if a]
    subject, body = head("Subject").strip(), _body(message)
    digest = hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()
    key = hashlib.sha256("|".join([sender, iso or "none", subject, digest]).encode("utf-8", "replace")).hexdigest()
    return {"message_id": name, "date": date, "date_iso": iso, "sender": sender, "recipients": listed, "subject": subject, "body": body, "in_reply_to": _one(head("In-Reply-To")) or None,
            "references": _ID.findall(head("References")), "folder_path": folder, "raw_text": raw.decode("utf-8", "replace"), "body_hash": digest, "dedup_key": key}


def read_maildir(spark: SparkSession, base: str, users: Sequence[str] | None = None) -> DataFrame:
    """Messages below ``base``/user/folder; files without a Message-ID are left out. Folders of other users are not listed. Where
    there is no such folder there are no messages."""
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], FIELDS)
    path = base.rstrip("/") + ("/{" + ",".join(users) + "}" if users else "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "^.*?" + re.escape(base.rstrip("/").split("://")[-1]) + "/?", "")
    arrow = pa.schema([("message_id", pa.string()), ("date", pa.timestamp("us", "UTC")), ("date_iso", pa.string()), ("sender", pa.string()), ("recipients", pa.list_(pa.string())), ("subject", pa.string()), ("body", pa.string()), ("in_reply_to", pa.string()),
                       ("references", pa.list_(pa.string())), ("folder_path", pa.string()), ("raw_text", pa.string()), ("body_hash", pa.string()), ("dedup_key", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [m for raw, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) if (m := parse_message(raw.as_py() or b"", at))]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("content", folder.alias("folder")).mapInArrow(run, FIELDS)
