"""Colour themes: a CSS rule for a theme's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Main, light and accent colour by theme.
THEMES = {
    "purple": ("#4527a0", "#5e35b1", "#00897b"),
    "blue": ("#1565c0", "#1e88e5", "#00897b"),
    "green": ("#2e7d32", "#43a047", "#00897b"),
    "teal": ("#00695c", "#00897b", "#5e35b1"),
    "red": ("#c62828", "#e53935", "#00695c"),
    "orange": ("#e65100", "#f57c00", "#00695c"),
    "gray": ("#37474f", "#546e7a", "#00897b"),
}
# The rule.
RULE = "/* ── color theme: %s ── */\n:root { --primary: %s; --primary-light: %s; --accent: %s; }"


def theme_css(name: Column) -> Column:
    """The rule of a theme, whatever the case of its name; an unknown name is an error that lists the known ones."""
    key = F.lower(name)
    colours = F.create_map(*[x for k, v in THEMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.try_element_at(colours, key)
    css = F.format_string(RULE, key, found[0], found[1], found[2])
    unknown = F.raise_error(F.format_string(f"unknown colour theme %s (known: {', '.join(sorted(THEMES))})", name))
    return F.when(name.isNull() | found.isNotNull(), F.when(found.isNotNull(), css)).otherwise(unknown)
