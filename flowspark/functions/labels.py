"""Label comparison and free-text class normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions.text import lookup, strip


def is_benign(label: Column) -> Column:
    return F.coalesce(F.lower(strip(label)).isin(*D.BENIGN_LABELS), F.lit(False))


def is_threat(label: Column) -> Column:
    """Every known label that is not benign, including failures; null is no threat."""
    return label.isNotNull() & ~is_benign(label)


def threat_target(label: Column) -> Column:
    """Training target: 0 for benign, 1 for everything else, null included."""
    return F.when(is_benign(label), 0.0).otherwise(1.0)


def canonical_label(label: Column) -> Column:
    """Lower-case label with alias spellings replaced by their group name."""
    key = F.lower(strip(label))
    groups = {alias: group for group, aliases in D.LABEL_ALIASES.items() for alias in aliases}
    return F.coalesce(lookup(groups, key), key)


def labels_match(predicted: Column, actual: Column) -> Column:
    """Equal up to case, blanks and alias group; null or empty never matches."""
    filled = (predicted != "") & (actual != "")
    return F.coalesce(filled & (canonical_label(predicted) == canonical_label(actual)), F.lit(False))


def normalise_attack_type(text: Column) -> Column:
    """Unified class of a free-text answer: exact key, else first key contained, else default."""
    key = F.lower(strip(text))
    contained = F
    for name, label in D.ATTACK_TYPE_KEYS:
        contained = contained.when(key.contains(name), label)
    contained = contained.otherwise(D.DEFAULT_ATTACK_CLASS)
    return F.coalesce(lookup(dict(D.ATTACK_TYPE_KEYS), key), contained)
