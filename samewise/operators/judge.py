"""Judgement of pairs and of candidates by a language model, behind a plug-in client.

A client is made once per task by a factory that the user supplies; it takes a prompt and returns text. Pairs are
batched in partitions and decisions are written to Parquet. With a progress folder they are written in groups,
each by a job of its own: a run that breaks off is taken up there, and only what is not written yet is asked
again. Secrets belong into the environment of the executors, not into closures.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.errors import ConfigurationError
from samewise.operators.match import MatchResult, expand_classes
from samewise.operators.order import join_dealt, running, spread
from samewise.operators.pairs import first_rows
from samewise.operators.rules import ValidationResult
from samewise.sources.shared import materialize, materialize_counted

KEPT_BY_DEFAULT, KEPT_ON_FAILURE = "No decision; kept", "Judge failed; kept"


class Client(Protocol):
    def __call__(self, prompt: str) -> str: ...


def reply_json(text: str) -> dict:
    """The JSON object of a reply: fenced, else from the first brace to the last."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    braces = re.search(r"\{.*\}", text, re.S)
    return json.loads(fenced[1] if fenced else braces[0] if braces else text)


def ask(client: Client, prompt: str, retries: int, pause: float = 1.0) -> dict | None:
    """The parsed reply, or None once the tries are used up; waits double."""
    for i in range(max(1, retries)):
        try:
            return reply_json(client(prompt))
        except Exception:  # any failure of a provider or a reply is tried again
            if i + 1 < retries:
                time.sleep(pause * 2**i)
    return None


#: What tells pairs apart: rows that agree in all of these are asked about once.
_PAIR = ("id1", "id2", "name1", "name2", "similarity_score")


def _row_key(columns: list[str]) -> Column:
    """The values themselves, as JSON, so that no two different pairs have one key; nulls are left out of the object."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in _PAIR if c in columns]))


def _answers(todo: DataFrame, key: str, run, schema: str, n_workers: int | None, progress: str | None, groups: int, arrow: bool = False) -> tuple[DataFrame, int, int]:
    """What run says of the rows of todo, written once; with a progress folder in equal groups of rows in the order of
    key, appended there, without asking about keys that are there already. Besides, how many batches were sent to the
    judge, earlier ones included, and how many of them lay in the progress folder; run marks the first row of a batch,
    and takes frames, or Arrow batches if so told."""
    batches = F.count_if("_first").alias("n")
    tasks = n_workers or int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def asked(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(tasks)
        return dealt.mapInArrow(run, schema) if arrow else dealt.mapInPandas(run, schema)

    if progress is None:
        answers, seen = materialize_counted(asked(todo), "answers", {"n": batches})
        return answers.drop("_first"), seen["n"], 0
    if groups < 1:
        raise ConfigurationError("a progress folder needs a group at least", groups=groups)
    spark = todo.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(progress)
    done = spark.read.schema(schema).parquet(progress)
    answer_key, before = done.columns[0], done.agg(batches).first().n
    left = running(todo.join(done.select(F.col(answer_key).alias(key)).distinct(), key, "left_anti"), [F.col(key)], {"_at": F.lit(1)})
    group = F.floor(F.col("_at") * groups / F.lit(max(left.count(), 1)))
    for g in range(groups):
        part = left.where(group == g).drop("_at")
        if not part.isEmpty():
            asked(part).write.mode("append").parquet(progress)
    answers = spark.read.schema(schema).parquet(progress)
    return answers.drop("_first").dropDuplicates([answer_key]), answers.agg(batches).first().n, before


def pair_prompt(rows: list[dict], columns: list[str], instructions: str = "") -> str:
    lines = []
    for r in rows:
        facts = "; ".join(f"{c}: {r.get(c + '_1') if r.get(c + '_1') is not None else 'N/A'} vs {r.get(c + '_2') if r.get(c + '_2') is not None else 'N/A'}" for c in columns)
        lines.append(f"{r['pair_index']}. {r['name1']!r} and {r['name2']!r}, score {r['similarity_score']:.1f}" + (f" ({facts})" if facts else ""))
    return (
        "Decide for each numbered pair whether both names mean the same entity.\n" + (instructions + "\n" if instructions else "") + "\n".join(lines)
        + '\nAnswer with JSON only: {"decisions": [{"pair_index": number, "is_duplicate": true or false, "reason": "short"}]}'
    )


def _truth(value) -> bool:
    return value.strip().lower() in ("true", "yes", "1") if isinstance(value, str) else bool(value)


@dataclass
class LLMValidator:
    """Keeps pairs that the judge calls duplicates; without a decision, or if the judge fails, a pair is kept."""

    client: Callable[[], Client]
    batch_size: int = 10
    n_workers: int | None = None
    max_retries: int = 3
    metadata_columns: list[str] = field(default_factory=list)
    instructions: str = ""
    pause: float = 1.0
    progress: str | None = None
    progress_groups: int = 8

    def _judge(self):
        make, size, retries, columns, more, pause = self.client, self.batch_size, self.max_retries, self.metadata_columns, self.instructions, self.pause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make()
            for frame in batches:
                told, got = frame.astype(object).where(frame.notna(), None).to_dict("records"), []
                for at in range(0, len(told), size):
                    rows = [{**r, "pair_index": i} for i, r in enumerate(told[at : at + size])]
                    reply = ask(client, pair_prompt(rows, columns, more), retries, pause)
                    found = {}
                    for d in (reply or {}).get("decisions", []):
                        if isinstance(d, dict) and isinstance(d.get("pair_index"), int) and 0 <= d["pair_index"] < len(rows):
                            found[d["pair_index"]] = (_truth(d.get("is_duplicate", True)), str(d.get("reason", "")))
                    other = (True, KEPT_ON_FAILURE if reply is None else KEPT_BY_DEFAULT)
                    got += [found.get(i, other) for i in range(len(rows))]
                yield pd.DataFrame({"_pair": frame["_pair"].to_numpy(), "keep": [g[0] for g in got], "validation_reason": [g[1] for g in got], "_first": [i % size == 0 for i in range(len(got))]})

        return run

    def _by_class(self, found: MatchResult, entities: DataFrame, id_column: str, order_by: str | None) -> ValidationResult:
        """The judge is asked once about rows that agree in name, as written, and in what it is told of them: a prompt holds nothing
        else. Its decisions meet the rows afterwards. Classes pair in the order in which some of their rows do."""
        have = [c for c in self.metadata_columns if c in entities.columns and c != id_column]
        order = [order_by] if order_by in entities.columns and order_by not in (id_column, *have) else []
        facts = first_rows(entities.select(id_column, *have, *order), id_column, order[0] if order else None).select(F.col(id_column).alias("_id"), *[F.col(c).alias(f"_of_{c}") for c in have])
        rows = found.classes.rows.join(facts, F.col("id") == F.col("_id"), "left").drop("_id")
        told = ["name", "raw", *[f"_of_{c}" for c in have]]
        rows = rows.withColumn("_told", F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in told])))
        sized = rows.groupBy("_told", *told).agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        sized = materialize(sized.withColumn("c", F.monotonically_increasing_id()), "classes")
        a, b = (
            sized.select(F.col("name").alias(f"name_{x}"), F.col("raw").alias(f"name{i}"), *[F.col(f"`_of_{c}`").alias(f"{c}_{i}") for c in have], *[F.col(c).alias(f"{c}_{x}") for c in ("c", "n", "low", "high")])
            for i, x in ((1, "a"), (2, "b"))
        )
        met = spread(a.join(found.classes.edges(), "name_a"), "name_b").join(b, "name_b").where("low_a < high_b")
        asked = materialize(met.drop("name_a", "name_b").withColumn("_pair", F.concat_ws("-", "c_a", "c_b")), "asked")
        schema = "_pair string, keep boolean, validation_reason string, _first boolean"
        answered, batches, before = _answers(asked.drop("c_a", "c_b", "n_a", "n_b", "low_a", "high_a", "low_b", "high_b"), "_pair", self._judge(), schema, self.n_workers, None, self.progress_groups)
        decided = materialize(asked.join(answered, "_pair").select("c_a", "c_b", "n_a", "n_b", "similarity_score", "keep", "validation_reason"), "decided")
        members = join_dealt(rows.select("id", "raw", "at", "_told"), sized.select("_told", "c"), "_told").drop("_told")
        out = expand_classes(members, "c", decided.drop("n_a", "n_b"), []).select("id1", "id2", "name1", "name2", "similarity_score", "keep", "validation_reason")

        def tally() -> tuple[int, int] | None:
            number = F.when(F.col("c_a") == F.col("c_b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
            per = decided.groupBy(F.least("c_a", "c_b").alias("x"), F.greatest("c_a", "c_b").alias("y")).agg(F.max(number).alias("n"), F.bool_and("keep").alias("all"), F.bool_or("keep").alias("any"))
            got = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("all"), F.col("n"))), F.lit(0)).alias("kept"), F.count_if(F.col("all") != F.col("any")).alias("mixed")).first()
            return None if got.mixed else (got.n, got.kept)

        return ValidationResult(out, self._facts(batches, before), tally=tally)

    def _facts(self, batches: int, before: int) -> dict:
        facts = {"batches_processed": batches, "batches_from_checkpoint": before, "custom_rules_applied": bool(self.instructions), "metadata_columns_used": self.metadata_columns}
        return {"model": getattr(self.client, "model", None), "provider": getattr(self.client, "provider", None), "batch_size": self.batch_size, **facts}

    def validate(
        self, pairs: DataFrame | MatchResult, entities: DataFrame, id_column: str = "id", order_by: str | None = None, entities2: DataFrame | None = None, id_column2: str | None = None, decided: DataFrame | None = None, progress: str | None = None,
    ) -> ValidationResult:
        """Annotated pairs. A second table serves id2. decided (id1, id2, keep, validation_reason; name1, name2 and
        similarity_score if it has them) holds earlier decisions, which are reused; progress is a folder where decisions are
        kept as they are made. A decision is about one row: pairs of the same ids with other names or scores get their own,
        but for decided without these columns, which speaks of all rows of its ids. The match itself instead of its pairs
        asks once about rows that agree in all that a prompt tells, if there are no earlier decisions or progress to mind."""
        if isinstance(pairs, MatchResult):
            if pairs.classes is not None and entities2 is None and decided is None and not (progress or self.progress):
                return self._by_class(pairs, entities, id_column, order_by)
            pairs = pairs.pairs
        told = [c for c in pairs.columns if decided is None or c in decided.columns]
        keyed = pairs.withColumn("_pair", _row_key(pairs.columns)).withColumn("_told", _row_key(told)).dropDuplicates(["_pair"])
        for n, table, key in (("1", entities, id_column), ("2", entities2 if entities2 is not None else entities, id_column2 or id_column)):
            have = [c for c in self.metadata_columns if c in table.columns and c != key]
            if have:
                side = first_rows(table.select(key, *have, *([order_by] if order_by in table.columns and order_by not in (key, *have) else [])), key, order_by if order_by in table.columns else None).select(F.col(key).alias("_k"), *[F.col(c).alias(f"{c}_{n}") for c in have])
                keyed = keyed.join(side, F.col(f"id{n}") == F.col("_k"), "left").drop("_k")
        todo = keyed
        if decided is not None:
            earlier = decided.withColumn("_told", _row_key(told)).select("_told", "keep", "validation_reason").dropDuplicates(["_told"])
            todo = keyed.join(earlier, "_told", "left_anti")
        answered, batches, before = _answers(todo.drop("_told"), "_pair", self._judge(), "_pair string, keep boolean, validation_reason string, _first boolean", self.n_workers, progress or self.progress, self.progress_groups)
        if decided is not None:
            answered = answered.select("_pair", "keep", "validation_reason").union(keyed.select("_pair", "_told").join(earlier, "_told").select("_pair", "keep", "validation_reason"))
        out = pairs.withColumn("_pair", _row_key(pairs.columns)).join(answered.dropDuplicates(["_pair"]), "_pair", "left").drop("_pair")
        kept = out.withColumn("keep", F.coalesce("keep", F.lit(True))).withColumn("validation_reason", F.coalesce("validation_reason", F.lit(KEPT_BY_DEFAULT)))
        return ValidationResult(kept, self._facts(batches, before))


def candidate_prompt(rows: list[dict], instructions: str = "") -> str:
    lines = []
    for r in rows:
        lines.append(f"Entity {r['df1_id']} ({r['df1_name']!r}):")
        for i, c in enumerate(r["candidates"]):
            facts = "; ".join(f"{k}: {v if v is not None else 'N/A'}" for k, v in (c.get("facts") or {}).items())
            lines.append(f"  {i}. id {c['df2_id']}: {c['df2_name']!r}, score {c['similarity_score']:.1f}" + (f" ({facts})" if facts else ""))
    return (
        "Choose for each entity the candidate that means the same.\n" + (instructions + "\n" if instructions else "") + "\n".join(lines)
        + '\nAnswer with JSON only: {"selections": [{"entity_id": id, "selected_candidate_index": number, "selected_candidate_id": id, "reasoning": "short"}]}'
    )


def _candidate(c: dict) -> dict:
    return {**c, "facts": {x["key"]: x["value"] for x in c["facts"] or []}}


def consolidate_by_judge(matches: DataFrame, df1: DataFrame, id1: str, client: Callable[[], Client], id2: str = "df2_id", batch_size: int = 5, n_workers: int | None = None, max_retries: int = 3, instructions: str = "", pause: float = 1.0, enabled: bool = True, decided: DataFrame | None = None, df2: DataFrame | None = None, df2_key: str = "id", metadata_columns: tuple[str, ...] = (), progress: str | None = None, progress_groups: int = 8) -> DataFrame:
    """One row per id of df1 with main_<id2>, main_name, main_similarity_score, llm_reasoning, total_matches and
    other_candidates (ids, best score first). metadata_columns of df2 (by df2_key) are told to the judge.

    The candidate named by id is taken, else by index, else the first; ids are compared as strings. If the
    judge fails, the best score is taken. Entities without a decision have no main match and total 0, as all
    have when it is not enabled. decided holds rows of an earlier result (df1's id as `_of` and the columns
    added here); their entities are not asked about again. progress is a folder where selections are kept as they
    are made.
    """
    if not enabled:
        matches = matches.limit(0)
    facts = F.create_map().cast("map<string,string>")
    have = [c for c in metadata_columns if df2 is not None and c in df2.columns]
    if have:
        side = first_rows(df2.select(df2_key, *have), df2_key).select(F.col(df2_key).alias("_k"), F.create_map(*[x for c in have for x in (F.lit(c), F.col(c).cast("string"))]).alias("_facts"))
        matches, facts = matches.join(side, F.col("df2_id") == F.col("_k"), "left").drop("_k"), F.col("_facts")
    # a map has no order, so entries carry it as an array to be sorted
    entry = F.struct((-F.col("similarity_score")).alias("s"), F.col("df2_id").cast("string").alias("df2_id"), "df2_name", "similarity_score", F.map_entries(facts).alias("facts"))
    grouped = matches.groupBy("df1_id").agg(F.first("df1_name").alias("df1_name"), F.sort_array(F.collect_list(entry)).alias("candidates"))

    kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = client()
        for batch in batches:
            # answers leave by the batch: a frame or batch for each prompt costs several times what the rest does
            out = []
            for at in range(0, batch.num_rows, batch_size):
                rows = [{**r, "df1_id": r["df1_id"].replace(tzinfo=None) if isinstance(r["df1_id"], datetime) else r["df1_id"], "candidates": [_candidate(c) for c in r["candidates"]]} for r in batch.slice(at, batch_size).to_pylist()]
                reply = ask(judge, candidate_prompt(rows, instructions), max_retries, pause)
                said = {str(s.get("entity_id")): s for s in (reply or {}).get("selections", []) if isinstance(s, dict)}
                for n, r in enumerate(rows):
                    chosen, reason = None, None
                    if reply is None:
                        chosen, reason = r["candidates"][0], "Judge failed; highest score"
                    elif (s := said.get(str(r["df1_id"]))) is not None:
                        by_id = [c for c in r["candidates"] if c["df2_id"] == str(s.get("selected_candidate_id"))]
                        i = s.get("selected_candidate_index")
                        chosen = by_id[0] if by_id else r["candidates"][i] if isinstance(i, int) and 0 <= i < len(r["candidates"]) else r["candidates"][0]
                        reason = str(s.get("reasoning", ""))
                    others = ", ".join(c["df2_id"] for c in r["candidates"] if c is not chosen) or None
                    out.append((*((chosen["df2_id"], chosen["df2_name"], chosen["similarity_score"], reason, len(r["candidates"]), others) if chosen else (None, None, None, None, 0, None)), n == 0))
            answers = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("df1_id"), *answers], ["_of", f"main_{id2}", "main_name", "main_similarity_score", "llm_reasoning", "total_matches", "other_candidates", "_first"])

    schema = f"_of {grouped.schema['df1_id'].dataType.simpleString()}, main_{id2} string, main_name string, main_similarity_score double, llm_reasoning string, total_matches long, other_candidates string, _first boolean"
    todo = grouped if decided is None else grouped.join(decided.select(F.col("_of").alias("df1_id")), "df1_id", "left_anti")
    answers, _, _ = _answers(todo, "df1_id", run, schema, n_workers, progress, progress_groups, arrow=True)
    if decided is not None:
        answers = answers.unionByName(decided.select(*[c for c in answers.columns if c in decided.columns]), allowMissingColumns=True)
    return first_rows(df1, id1).join(answers, F.col(id1) == F.col("_of"), "left").drop("_of").fillna(0, ["total_matches"])
