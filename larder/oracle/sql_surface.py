"""Checking SQL for the queries written in SQL: the rules spelled out, the page from the view."""

from __future__ import annotations

from larder.oracle.catalog import ORACLE as CATALOG
from larder.oracle.prefix import ERRORS, WARNINGS, with_catalog

RULES = {
    "missing": ERRORS["missing_required"], "protein_over": ERRORS["protein_exceeds_serving"], "few_servings": ERRORS["servings_below_min"],
    "implied": ERRORS["implied_serving_too_big"], "serving_odd": WARNINGS["serving_size_range"], "servings_odd": WARNINGS["servings_range"],
    "calories_off": WARNINGS["calories_disagree"], "container_off": WARNINGS["container_disagrees"],
}

ORACLE = {
    "page_listings_sql": CATALOG["page_listings"],
    "sale_percent_sql": CATALOG["sale_percent"],
    "validate_rules_sql": with_catalog(
        "SELECT variant_id, " + ", ".join(f"coalesce({cond}, false) AS {name}" for name, cond in RULES.items()) + " FROM candidates"),
}
