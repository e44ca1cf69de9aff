"""Column-expression helpers (all built-in Spark expressions, no UDFs)."""

from ridelens.functions.numeric import ratio, round_mean_half_up
from ridelens.functions.text import (any_phrase, literal_pattern, phrase_occurrences)
from ridelens.functions.time import minute_field, time_parts

__all__ = ["ratio", "round_mean_half_up", "any_phrase", "literal_pattern",
           "phrase_occurrences", "minute_field", "time_parts"]
