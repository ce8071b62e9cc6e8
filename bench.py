"""Time the headline queries: one JSON line with seconds per query and in total.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query runs to the end
(rows are written to the no-op sink); the session is warmed on a scan that is not counted.
"""

from __future__ import annotations

import json
import os
import time

from starloom.catalog import load_all
from starloom.catalog.registry import QUERIES
from starloom.plans.session import build_session

HEADLINE = [
    "flagship_words_by_language", "s1_tsv_convert", "s4_json_lines", "p9_vote_features", "p11_parse_description",
    "t5_expand_contractions", "t10_tokenize", "t11_remove_stop_words", "t13_lemmatize", "t17_normalize_documents",
    "a1_group_share", "a4_word_count_deciles", "a7_describe", "a8_date_parts", "a12_word_counts", "a16_correlations", "a18_bootstrap_interval",
    "j1_merge_predictions", "j5_vocabulary_vectors", "j7_split_known_words", "w1_improvement", "w2_best_run",
    "f1_ngrams", "f2_bag_of_words", "f3_tfidf", "f8_average_vectors", "f10_encode_sequences", "f13_missing_by_size",
    "m1_systematic_sample", "m4_stratified_split", "m5_over_sample", "m7_smote", "m9_near_miss", "m11_class_weights",
    "l1_logistic_regression", "l2_decision_tree", "l6_knn_classify",
    "e1_confusion_matrix", "e2_classification_report", "e3_overall_score", "e5_roc_auc", "e12_contributions", "r2_stream_log",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.monotonic()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
