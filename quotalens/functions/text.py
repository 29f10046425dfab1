"""Business wording for feature names: labels, reason codes and suggested actions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Manager-facing names of fields.
FIELD_LABELS = {
    "total_sales": "Sales", "total_quantity": "Quantity", "distinct_customers": "Customer coverage",
    "distinct_products": "Product breadth", "distinct_cities": "City coverage",
    "simulated_actual_payout": "DEMO payout", "simulated_expected_incentive": "DEMO expected incentive",
    "simulated_adjustment": "DEMO adjustment", "simulated_payout_delta": "DEMO payout difference",
    "simulated_payout_delta_pct": "DEMO payout difference (%)",
    "simulated_payout_to_sales_ratio": "DEMO payout relative to sales",
    "simulated_target_attainment_pct": "DEMO target attainment (%)",
    "country_mix": "Country mix diversity", "channel_mix": "Channel mix diversity",
    "subchannel_mix": "Subchannel mix diversity", "geographic_spread": "Geographic dispersion",
}

# Wording of derived-feature endings.
SUFFIX_LABELS = {
    "_history_deviation": "personal history deviation", "_peer_z": "peer deviation", "_peer_percentile": "peer percentile",
    "_peer_median": "peer median", "_month_over_month_growth": "month-over-month change",
    "_year_over_year_growth": "year-over-year change", "_rolling_MAD": "prior historical variation",
    "_trend": "prior trend", "_acceleration": "change in growth",
}

# Words that decide the topic of the suggested action, in order of precedence.
ACTION_WORDS = {
    "payout": ("incentive", "payout", "attainment", "target", "quota", "accelerator", "adjustment"),
    "orders": ("discount", "return", "cancel", "order", "sales"),
    "visits": ("visit", "crm", "interaction", "travel", "expense", "distance"),
    "capacity": ("capacity", "utilization", "workload", "fte", "coverage"),
}
ACTION_TEXT = {
    "payout": "Validate the target, policy tier, adjustment approval, and payout reconciliation before action.",
    "orders": "Validate the underlying orders, discounts, returns, period timing, and customer context before action.",
    "visits": "Validate visit, CRM, route, and expense records with the representative and manager before action.",
    "capacity": "Review workload assumptions, customer coverage, and available capacity; do not treat this as an automated staffing decision.",
    "general": "Validate the source record, peer context, and relevant commercial activity before action.",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sentence(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.greatest(F.length(text), F.lit(1)))))


def plain_label(feature) -> Column:
    """Underscores to blanks, first letter upper case."""
    return _sentence(F.trim(F.regexp_replace(F.regexp_replace(_c(feature), "^simulated_", ""), "_", " ")))


def manager_label(feature) -> Column:
    """Known fields by name, known endings as ``field: ending``, anything else plainly."""
    f = _c(feature)
    known = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])

    def base(name: Column) -> Column:
        out = F.element_at(known, name)
        for prefix, label in FIELD_LABELS.items():
            rest = F.regexp_replace(F.substring(name, F.lit(len(prefix) + 2), F.greatest(F.length(name), F.lit(1))), "_", " ")
            out = F.coalesce(out, F.when(name.startswith(prefix + "_"), F.concat(F.lit(label + ": "), rest)))
        return F.coalesce(out, plain_label(name))

    out = F.element_at(known, f)
    for ending, label in SUFFIX_LABELS.items():
        stem = F.regexp_replace(f, ending + "$", "")
        out = F.coalesce(out, F.when(f.endswith(ending), F.concat(base(stem), F.lit(": " + label))))
    return F.when(f.isNotNull(), F.coalesce(out, base(f)))


def reason_code(feature, prefix: str = "PCA_RECONSTRUCTION") -> Column:
    token = F.regexp_replace(F.upper(_c(feature)), "[^A-Z0-9]+", "_")
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(token, "^_+|_+$", ""))


def action_topic(feature) -> Column:
    name = F.lower(_c(feature))
    out = None
    for topic, words in ACTION_WORDS.items():
        hit = name.rlike("|".join(words))
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out.otherwise("general")


def recommended_action(feature) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in ACTION_TEXT.items() for x in pair])
    return F.element_at(texts, action_topic(feature))


def short_number(c) -> Column:
    """Four significant digits for sentences; ``unavailable`` when missing."""
    value = _c(c).cast("double")
    return F.when(value.isNull(), "unavailable").otherwise(F.format_string("%,.4g", value))
