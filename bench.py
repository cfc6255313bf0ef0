"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
HEADLINE = ["tokens_per_doc", "spell_words", "spell_misspelled_per_doc", "bad_lines", "derivations", "analyses", "expand_forms", "overlay_verdicts", "compound_splits", "check_texts"]


def engine_rates() -> dict[str, float]:
    """Calls a second of the single-word engine on one core, with an invented dictionary of 49,568 entries."""
    import random

    from lexloom.plans import invented

    began = time.perf_counter()
    e = invented.dictionary().engine
    out = {"load_ms": round(1000 * (time.perf_counter() - began))}
    r = random.Random(3)
    listed = r.sample(invented.words(), 1000)
    affixed = [f for w in listed for f in e.expand(w) if not e.has_word(f)][:1000]
    wrong = [w[:i] + r.choice("abcdexyz") + w[i + 1 :] + r.choice(("", "q")) for w in listed for i in [r.randrange(len(w))]]
    wrong = [w for w in wrong if not e.spell(w)]
    e.suggest(wrong[0])  # builds the index
    for name, fn, words in (("spell_listed", e.spell, listed), ("spell_affixed", e.spell, affixed), ("spell_wrong", e.spell, wrong), ("analyze", e.analyze, listed), ("stem", e.stem, listed), ("suggest", e.suggest, wrong[:60])):
        began, n = time.perf_counter(), 0
        while time.perf_counter() - began < 0.4:
            for w in words:
                fn(w)
            n += len(words)
        out[name] = round(n / (time.perf_counter() - began))
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, str(ROOT))
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from pyspark.sql import SparkSession

    from lexloom.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["tokens_per_doc"](spark, sf_dir).count()  # starts workers and compiles
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(size(regexp_extract_all(text, '[\\\\p{L}\\\\p{M}]+', 0))) AS n").first()[0]
    extra = {"tokens": words, "tokens_checked_per_sec": round(words / times["spell_misspelled_per_doc"]), "engine_calls_per_sec": engine_rates()}
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(Path(sf_dir).name.removeprefix("sf")) if Path(sf_dir).name.startswith("sf") else sf_dir, **extra}))


if __name__ == "__main__":
    main()
