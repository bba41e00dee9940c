"""Model calls on partitions (U1, U2). Any callable fits; the default works offline.

Replies go to a store on shared storage as they come in (``replies.py``), so that neither a
task that is retried nor the next run of the job asks the same thing again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.operators.replies import FLUSH, Buckets, read_replies, reply_key
from lathe.sources.tables import checkpoint, new_folder

Message = dict[str, str]
#: messages -> {"message": {"content": …}, "usage": {"prompt_tokens": …, "completion_tokens": …}}
Chat = Callable[[list[Message]], dict[str, Any]]


def offline_client() -> Chat:
    """Replies with the last message's first line; usage counts blank-split words."""

    def chat(messages: list[Message]) -> dict[str, Any]:
        last = messages[-1]["content"] if messages else ""
        reply = last.split("\n", 1)[0]
        return {"message": {"content": reply}, "usage": {"prompt_tokens": sum(len(m["content"].split()) for m in messages), "completion_tokens": len(reply.split())}}

    return chat


CALL_COLUMNS = "reply string, prompt_tokens bigint, completion_tokens bigint, error string"


def _ask(chat: Chat, messages: list[Message]) -> tuple[str, int, int, str | None]:
    try:
        got = chat(messages)
        usage = got.get("usage") or {}
        return str(got["message"].get("content") or ""), int(usage.get("prompt_tokens", 0)), int(usage.get("completion_tokens", 0)), None
    except Exception as e:  # a service's failure is a row's result, not the job's
        return "", 0, 0, f"{type(e).__name__}: {e}"


#: Calls of one task at most, and hexadecimal digits of the hash that names a bucket of the store.
TASK_CALLS, BUCKET_DIGITS = 500, 3


def _tasks(calls: int, concurrency: int) -> int:
    """Tasks for so many calls; not more than there are buckets, as the rest would be empty."""
    return max(concurrency, min(-(-calls // TASK_CALLS), 16**BUCKET_DIGITS))


def call_model(rows: DataFrame, make_client: Callable[[], Chat] = offline_client, concurrency: int = 8, store: str | None = None, flush: int = FLUSH) -> DataFrame:
    """``rows`` with system_prompt and user_prompt -> with reply, token counts and error (null if the call went well).

    Equal prompts are one call. Only those are made that ``store``, a folder on shared
    storage (of this call alone by default), has no reply to; in ``concurrency`` tasks
    at least, and more for many calls. ``make_client`` is called once in each. A failed
    call gives an empty reply, 0 tokens and its error, and is made again by the next run.
    """
    spark, path = rows.sparkSession, store or new_folder(rows.sparkSession, "replies")
    keyed = rows.withColumn("_call", F.sha2(F.to_json(F.array(F.coalesce("system_prompt", F.lit("")), F.coalesce("user_prompt", F.lit("")))), 256))
    known = read_replies(spark, path).select(F.col("key").alias("_call"))
    asked = checkpoint(keyed.select("_call", "system_prompt", "user_prompt").dropDuplicates(["_call"]).join(known, "_call", "left_anti"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, failed = make_client(), []
        with Buckets(path, flush) as buckets:
            for pdf in batches:
                for key, s, u in zip(pdf["_call"], pdf["system_prompt"], pdf["user_prompt"]):
                    messages = [{"role": r, "content": c} for r, c in (("system", s), ("user", u)) if c]
                    *_, error = buckets.at(key[:BUCKET_DIGITS]).ask(key, lambda messages=messages: _ask(chat, messages))
                    if error is not None:
                        failed.append((key, error))
        yield pd.DataFrame(failed, columns=["_call", "error"], dtype=str)

    n = _tasks(asked.count(), concurrency)
    dealt = asked.repartition(n, F.substring("_call", 1, BUCKET_DIGITS)).sortWithinPartitions("_call")
    errors = checkpoint(dealt.mapInPandas(run, "_call string, error string"))
    replies = read_replies(spark, path).withColumnRenamed("key", "_call")
    out = keyed.join(replies, "_call", "left").join(errors, "_call", "left")
    tokens = [F.coalesce(c, F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    return out.select(*rows.columns, F.coalesce("reply", F.lit("")).alias("reply"), *tokens, "error")


Asked = Callable[[list[Message]], tuple[str, int, int, str | None]]


def episode_turns(asked: Asked, mode: str, system: str, passage: str, challenge: str, procedure: list[str], max_steps: int = 8) -> tuple[list[str], int]:
    """The replies of one trial and their tokens.

    stepwise asks for a step until an empty or concluding one, at most
    ``max_steps``; guided asks for every step of the procedure and a synthesis;
    anything else, and guided without a procedure, is a single call.
    """
    said: list[str] = []
    tokens = 0

    def ask(user: str) -> str:
        nonlocal tokens
        reply, a, b, _ = asked([{"role": "system", "content": system}, {"role": "user", "content": user}])
        tokens += a + b
        return reply.strip()

    numbered = lambda: "\n".join(f"  {i}. {s}" for i, s in enumerate(said, 1)) or "  (no steps yet)"
    head = f"Passage: {passage}\n\nChallenge: {challenge}\n"
    if mode == "stepwise":
        for _ in range(max_steps):
            step = ask(f"{head}\nReasoning so far:\n{numbered()}\n\nWrite the next reasoning step:")
            if not step:
                break
            said.append(step)
            if step.upper().startswith("CONCLUDE:"):
                break
    elif mode == "guided" and procedure:
        for i, step in enumerate(procedure, 1):
            said.append(ask(f"{head}\nFindings so far:\n{numbered()}\n\nStep {i} of {len(procedure)}: {step}"))
        said.append(ask(f"{head}\nFindings:\n{numbered()}\n\nConclude."))
    else:
        said.append(ask(head))
    return said, tokens


def run_episodes(trials: DataFrame, make_client: Callable[[], Chat] = offline_client, concurrency: int = 8, max_steps: int = 8, store: str | None = None, flush: int = FLUSH) -> DataFrame:
    """Trials (task_uid, model, condition, mode, system_prompt, passage, challenge, procedure) -> replies, the numbered reply and tokens of each.

    A column ``repetition`` tells equal trials apart, if there is one. Replies are
    stored as in ``call_model``, by trial and messages: an episode that was cut off
    goes through its stored replies and asks from there on.
    """
    path = store or new_folder(trials.sparkSession, "replies")
    keys = ["task_uid", "model", "condition", "mode"]
    repetition = F.col("repetition").cast("string") if "repetition" in trials.columns else F.lit("")
    rows = trials.withColumn("_repetition", repetition).withColumn("_trial", F.sha2(F.to_json(F.array(*[F.coalesce(k, F.lit("")) for k in keys], "_repetition")), 256))
    rows = checkpoint(rows.select(*keys, "_trial", "system_prompt", "passage", "challenge", "procedure"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make_client()
        with Buckets(path, flush) as buckets:
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    trial = r["_trial"]
                    asked = lambda m, at=buckets.at(trial[:BUCKET_DIGITS]), trial=trial: at.ask(reply_key(m, trial), lambda: _ask(chat, m))
                    procedure = list(r["procedure"]) if r["procedure"] is not None else []
                    said, tokens = episode_turns(asked, r["mode"], r["system_prompt"] or "", r["passage"] or "", r["challenge"] or "", procedure, max_steps)
                    shown = said[0] if len(said) == 1 else "\n".join(f"{i}. {s}" for i, s in enumerate(said, 1))
                    out.append((*(r[k] for k in keys), said, shown, tokens))
                yield pd.DataFrame(out, columns=[*keys, "replies", "reply", "tokens"])

    dealt = rows.repartition(_tasks(rows.count(), concurrency), F.substring("_trial", 1, BUCKET_DIGITS)).sortWithinPartitions("_trial")
    return checkpoint(dealt.mapInPandas(run, "task_uid string, model string, condition string, mode string, replies array<string>, reply string, tokens bigint"))
