"""Document families by path fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.functions.text import composed

# Fragments in order of precedence, and their families.
RULES = (
    ("Règlement/Pièces écrites", "reglement_ecrit"),
    ("Règlement/Documents graphiques", "reglement_graphique"),
    ("Rapport de présentation", "rapport_presentation"),
    ("OAP", "oap"),
    ("PADD", "padd"),
    ("Annexes", "annexes"),
)
OTHER = "other"


def family(path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Family of the first rule whose fragment the composed path contains; OTHER without one."""
    path, out = composed(path), None
    for fragment, name in rules:
        out = (F if out is None else out).when(F.contains(path, F.lit(fragment)), F.lit(name))
    return out.otherwise(F.lit(OTHER)) if out is not None else F.lit(OTHER)
