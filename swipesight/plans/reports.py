"""Whole analyses: every table of a topic by name, lazily where Spark allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from swipesight.functions.stats import mann_whitney
from swipesight.operators import fraud, graph, metrics, models, profiling, temporal, timing_models
from swipesight.operators.hypotheses import product_hypotheses
from swipesight.sources import io

__all__ = ["model_report", "product_hypotheses", "profile", "save_results", "technical_hypotheses"]

KEY_CURRENCIES = ("EUR", "GBP", "JPY", "RUB")


def profile(
    transactions: DataFrame, rates: DataFrame, key_currencies: Sequence[str] = KEY_CURRENCIES
) -> dict[str, DataFrame]:
    """Exploratory profile of transactions and rates."""
    unpacked = profiling.unpack_last_hour(transactions)
    hours = [f"last_hour_{f}" for f in profiling.LAST_HOUR_FIELDS]
    out = {
        "shape": profiling.shape(transactions),
        "types": profiling.column_types(transactions),
        "first_rows": profiling.first_rows(transactions, ["timestamp", "transaction_id"]),
        "description": profiling.describe_numeric(transactions),
        "rates_range": profiling.date_range(rates),
        "missing": profiling.missing_values(transactions),
        "rates_missing": profiling.missing_values(rates),
        "label": fraud.label_distribution(transactions),
        "amount_histogram": profiling.histogram(transactions, "amount", 50),
        "amount_by_label": fraud.amount_by_label(transactions),
        "top_values": fraud.top_values(transactions),
        "by_hour": fraud.fraud_by_hour(transactions),
        "by_weekday": fraud.fraud_by_weekday(transactions),
        "currencies": profiling.currency_statistics(rates),
        "currency_series": profiling.rate_series(rates, [c for c in key_currencies if c in rates.columns]),
        "currency_correlations": profiling.correlation_matrix(rates, profiling.currency_names(rates)),
        "last_hour": profiling.describe_numeric(unpacked, hours),
        "last_hour_correlations": profiling.last_hour_correlations(transactions),
        "by_vendor_category": fraud.fraud_rate_by(transactions, "vendor_category", 10),
        "by_card_type": fraud.fraud_rate_by(transactions, "card_type"),
        "by_channel": fraud.fraud_rate_by(transactions, "channel"),
        "by_country": fraud.fraud_rate_by(transactions, "country", 10),
        "label_correlations": profiling.label_correlations(unpacked, "is_fraud"),
        "summary": profiling.dataset_summary(transactions, rates),
    }
    for a, b in fraud.CROSSTABS:
        out[f"{a}_by_{b}"] = fraud.fraud_crosstab(transactions, a, b)
    return out


def technical_hypotheses(df: DataFrame) -> dict[str, DataFrame]:
    """Time patterns, links between customers and timing behaviour."""
    clusters = temporal.time_clusters(df)
    links = graph.customer_graph(df)
    customers = df.where("customer_id IS NOT NULL").select("customer_id").distinct()
    parts = graph.connected_components(links.members, customers)
    groups = graph.communities(links.members, customers)
    per_customer = graph.customer_fraud(df)
    central = graph.degrees(links).join(graph.betweenness(links), "customer_id")
    patterns = temporal.arrival_patterns(df)
    community = graph.group_statistics(groups, per_customer, "community")
    return {
        "by_hour": fraud.fraud_by_hour(df),
        "by_weekday": fraud.fraud_by_weekday(df),
        "intervals": temporal.interval_counts(df),
        "autocorrelation": temporal.autocorrelation(temporal.hourly_series(df)),
        "time_clusters": temporal.cluster_statistics(clusters),
        "time_cluster_summary": temporal.cluster_summary(clusters),
        "clock_model": timing_models.clock_metrics(df),
        "clock_coefficients": timing_models.clock_coefficients(df),
        "components": graph.component_summary(parts),
        "communities": community,
        "modularity": graph.modularity(links.members, groups),
        "riskiest_communities": graph.riskiest_groups(community, "community"),
        "fraud_neighbourhood": graph.fraud_neighbourhood(groups, per_customer, "community"),
        "centrality": central,
        "centrality_fraud": graph.centrality_fraud(central, per_customer, ["degree_centrality", "betweenness"]),
        "fraud_trend": graph.fraud_trend(central, per_customer),
        "time_patterns": patterns,
        "bot_rates": temporal.group_fraud_rates(patterns),
        "bot_rank_test": mann_whitney(patterns, "fraud_rate", "bot_like"),
        "anomaly_rates": temporal.group_fraud_rates(timing_models.timing_anomalies(patterns), "time_anomaly"),
        "rhythm_accuracy": timing_models.rhythm_accuracy(patterns),
        "rhythm_components": timing_models.rhythm_components(patterns),
        "speed_segments": temporal.speed_segments(patterns),
    }


def model_report(trained: models.Trained) -> dict[str, DataFrame]:
    """Comparison, confusion, curves and business estimate of trained models."""
    return {
        "comparison": metrics.best_models(trained.metrics),
        "confusion": metrics.confusion_shares(trained.predictions, ["model"]),
        "roc": metrics.roc_points(trained.predictions, ["model"], grid=1000),
        "precision_recall": metrics.precision_recall_points(trained.predictions, ["model"], grid=1000),
        "business": models.report(trained),
    }


def save_results(trained: models.Trained, path: str) -> None:
    """Metrics as CSV, the best model's report as JSON, every fitted pipeline in its own folder."""
    io.write_metrics(metrics.best_models(trained.metrics), f"{path}/metrics")
    io.write_report(models.report(trained), f"{path}/report")
    io.save_models(trained.pipelines, f"{path}/models")
