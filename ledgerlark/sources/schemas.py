"""Row schemas of the ledger tables, as DDL that ``DataFrameReader.schema`` takes."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "competitions": (
        "competition_id string, name string, task_type string, metric string, metric_sign int, start_ts timestamp_ntz,"
        "fingerprint string, auto_submit_paused_reason string, train_fingerprint string, eval_fingerprint string"
    ),
    "attempts": (
        "attempt_id string, competition_id string, run_ts timestamp_ntz, stage string, hypothesis string,"
        "action_type string, model_type string, params string, features string, cv_score double, cv_fold_var double,"
        "lb_score double, label string, gain_vs_best double, error_trace string, reflection_ids array<string>,"
        "retrieval_scores array<double>, duration_sec double, code_path string, retries int, super_cycle_id string,"
        "was_promoted boolean, holdout_score double, confirm_seed_gains string, fold_scores array<double>,"
        "gain_vs_best_relative double, retrieved_ids array<string>, error_signature string, peak_rss_bytes bigint,"
        "peak_cpu_sec double, noop_early_exit boolean, futility_early_exit boolean"
    ),
    "pipelines": (
        "pipeline_id string, attempt_id string, competition_id string, fingerprint_snapshot string, code string,"
        "cv_score double, gain_vs_best double, pipeline_sha256 string, oof_preds string, materialized_code string,"
        "materialized_sha256 string, materialized_origin string, invalid_reason string, fold_scores array<double>"
    ),
    "reflections": (
        "reflection_id string, created_at timestamp_ntz, attempt_id string, competition_id string,"
        "embedded_text string, embedding array<float>, full_lesson string, generality string, label string,"
        "reflector_label string, lesson_type string, gain_vs_best double, archived boolean"
    ),
    "cycle_queue": (
        "queue_id string, competition string, stage string, n_cycles int, priority int, status string,"
        "created_at timestamp_ntz, started_at timestamp_ntz, ended_at timestamp_ntz, cycles_done int,"
        "latest_score double, error string, last_leased_at timestamp_ntz"
    ),
    "super_cycle_context": (
        "run_id string, queue_id string, super_cycle_id string, competition_id string, prev_best_cv double,"
        "lessons string, assigned_actions array<string>, created_at timestamp_ntz"
    ),
    "action_bandit": (
        "scope string, scope_key string, action_type string, alpha double, beta double, updated_at timestamp_ntz"
    ),
    "submissions": (
        "submission_id string, competition_id string, attempt_id string, submitted_at timestamp_ntz, message string,"
        "csv_path string, status string, lb_score double, error string, checked_at timestamp_ntz, lb_percentile double"
    ),
    "leaderboard_snapshot": ("competition_id string, fetched_at timestamp_ntz, n_teams int, scores array<double>"),
    "confirm_memo": (
        "memo_key string, competition_id string, cv_score double, fold_scores array<double>, holdout_score double,"
        "holdout_regressed boolean, seed_gains string, created_at timestamp_ntz"
    ),
    "baseline_eval_cache": (
        "cache_key string, competition_id string, mode string, seed int, score double, created_at timestamp_ntz"
    ),
    "tuned_params": (
        "id string, tuning_run_id string, competition_id string, model_type string, member_index int, params string,"
        "cv_score double, baseline_cv_score double, n_trials int, improved boolean, created_at timestamp_ntz"
    ),
}
