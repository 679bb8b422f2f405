"""Entities and claims from messages: prompts, a model that is asked with bounded concurrency, retries as rounds.

The model is a callable; the one given here works offline by rules. Each round asks it about the messages that are still open, in a pool of
threads a partition, with a limit of calls a minute and of seconds a call; what it raises stays with its message. Answers are
validated by ``validation.validated``, and only messages without a valid one take part in the next round, with what was wrong.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from datetime import datetime, timezone
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.validation import FIELDS, MIN_CONFIDENCE, validated
from emberline.session import scratch, stored

#: Recipients that a prompt lists, calls about a message, calls at once and a minute.
RECIPIENTS, ATTEMPTS, CONCURRENCY, PER_MINUTE = 10, 3, 20, 80


def user_prompt(rows: DataFrame) -> Column:
    """The message as a prompt: its head, the first ten recipients, the thread's context where there is one, and the body."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    to = F.array_join(F.slice(F.coalesce("recipients", F.array().cast("array<string>")), 1, RECIPIENTS), ", ")
    thread = F.when(F.coalesce("thread_context", F.lit("")) != "", F.concat(F.lit("\nTHREAD CONTEXT (prior messages summary):\n"), "thread_context")) if "thread_context" in rows.columns else F.lit(None).cast("string")
    return F.concat_ws("\n", F.lit("METADATA:"), F.concat(F.lit("From: "), text("sender")), F.concat(F.lit("To: "), to), F.concat(F.lit("Date: "), text("date")), F.concat(F.lit("Subject: "), text("subject")), thread, F.concat(F.lit("\nBODY:\n"), text("body")))


def prompt_hash(system: str, examples: list) -> str:
    """Twelve hexadecimal digits that name a prompt: the system text and the examples with their keys sorted."""
    return hashlib.sha256((system + json.dumps(examples, sort_keys=True)).encode()).hexdigest()[:12]


def version_tag(model: str, system: str, examples: list) -> str:
    return f"v1.0_{model}_{prompt_hash(system, examples)}"


def run_tag(tag: str) -> str:
    """A version tag with the time of this run, in UTC."""
    return f"{tag}_{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}"


def by_rules(prompt: str) -> str:
    """The offline model: every capitalised name of the body is a person, and the sender mentions each."""
    head, _, body = prompt.partition("\nBODY:\n")
    sender = re.search(r"^From: (.*)$", head, re.M)
    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", body)))
    who = (sender[1] if sender else "") or "unknown"
    entities = [{"name": n, "type": "Person", "aliases": [], "properties": {}} for n in [who, *names]]
    claims = [{"type": "MENTIONS", "subject": who, "object": n, "properties": {}, "evidence_excerpt": n, "confidence": 0.7} for n in names]
    return json.dumps({"entities": entities, "claims": claims})


class Pace:
    """At most ``per_minute`` starts in any minute, evenly spaced; of all threads of a task."""

    def __init__(self, per_minute: float | None):
        self.gap, self.next, self.lock = 60 / per_minute if per_minute else 0.0, 0.0, Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(at - now)


def asked(prompts: DataFrame, model: Callable[[str], str], concurrency: int = CONCURRENCY, per_minute: float | None = PER_MINUTE, seconds: float | None = None) -> DataFrame:
    """(message_id, raw_response, error) of (message_id, prompt), in the order of the rows of each partition.

    ``concurrency`` calls run at once in a partition, ``per_minute`` start there in a minute (None: no limit). A call that takes over
    ``seconds`` is given up (its thread ends by itself). Whatever a call raises is its row's error; other rows are not touched by it.
    """
    kind = prompts.schema["message_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(per_minute)

        def call(prompt: str) -> str:
            pace.wait()
            return model(prompt)

        pool = ThreadPoolExecutor(concurrency)
        try:
            for b in batches:
                texts = b["prompt"].to_pylist()
                raw, errors = [], []
                for at in range(0, len(texts), concurrency):
                    calls = [pool.submit(call, x) for x in texts[at : at + concurrency]]
                    end = time.monotonic() + seconds + pace.gap * len(calls) if seconds else None
                    for one in calls:
                        try:
                            raw.append(str(one.result(None if end is None else max(0.0, end - time.monotonic()))))
                            errors.append(None)
                        except TimeoutError:
                            one.cancel()
                            raw.append(None)
                            errors.append(f"TimeoutError: no answer in {seconds} s")
                        except Exception as e:  # noqa: BLE001 - whatever a model raises belongs to its message
                            raw.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([b["message_id"], pa.array(raw, pa.string()), pa.array(errors, pa.string())], ["message_id", "raw_response", "error"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return prompts.select("message_id", "prompt").mapInArrow(run, f"message_id {kind}, raw_response string, error string")


def extract(emails: DataFrame, model: Callable[[str], str] = by_rules, fallback: Callable[[str], str] | None = None, attempts: int = ATTEMPTS, min_confidence: float = MIN_CONFIDENCE, **pool) -> DataFrame:
    """(message_id, attempts, error, is_valid, entities, claims, events) of every message (unique message_id).

    A model that raises or gives an invalid answer is asked again, with what was wrong, up to ``attempts`` times, then the
    fallback once. What fails for good has an ``error`` and is not valid. ``pool``: concurrency, per_minute and seconds of ``asked``.
    """
    with scratch(emails.sparkSession) as own:
        rows = stored(emails.select("message_id", user_prompt(emails).alias("prompt"), F.coalesce("body", F.lit("")).alias("body")), "prompts")
        open_, done = rows.withColumn("wrong", F.lit(None).cast("string")), []
        rounds = [model] * attempts + [fallback] * (fallback is not None)
        for k, one in enumerate(rounds, 1):
            again = F.when(F.col("wrong").isNull(), F.col("prompt")).otherwise(F.concat("prompt", F.lit("\n\nThe last answer was not valid: "), "wrong"))
            answers = stored(asked(open_.select("message_id", again.alias("prompt")), one, **pool), "answers")
            said = answers.join(rows.select("message_id", "body"), "message_id")
            good = validated(said.filter("error IS NULL"), min_confidence)
            judged = answers.select("message_id", "error").join(good, "message_id", "left")
            reasons = F.array_join(F.transform("events", lambda e: e["reason"]), "; ")
            wrong = F.coalesce("error", F.when(reasons != "", reasons), F.lit("no entities"))
            valid = F.coalesce("is_valid", F.lit(False))
            empty = [F.coalesce(c, F.array()).alias(c) for c in FIELDS[1:]]
            judged = judged.select("message_id", F.lit(k).alias("attempts"), F.when(~valid, wrong).alias("error"), valid.alias("is_valid"), *empty)
            judged = stored(judged, "judged")
            done.append(judged if k == len(rounds) else judged.filter("is_valid"))
            if k < len(rounds):
                left = judged.filter("NOT is_valid").select("message_id", F.col("error").alias("wrong"))
                open_ = rows.join(left, "message_id")
                if left.isEmpty():
                    break
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return own.result(out, "extracted")


def extraction_stats(results: DataFrame) -> DataFrame:
    """One row: messages, how many succeeded and failed, the rate, entities, claims and dropped evidence."""
    dropped = F.size(F.filter("events", lambda e: e["reason"] == "evidence_not_found"))
    ok = F.count_if("is_valid")
    return results.agg(
        F.count(F.lit(1)).alias("total_emails"), ok.alias("successful"), F.count_if(~F.col("is_valid")).alias("failed"), F.round(F.coalesce(ok / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 3).alias("success_rate"),
        F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("total_entities"), F.coalesce(F.sum(F.size("claims")), F.lit(0)).alias("total_claims"), F.coalesce(F.sum(dropped), F.lit(0)).alias("total_evidence_dropped"),
    )
