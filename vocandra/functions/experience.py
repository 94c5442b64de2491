"""Experience asked for in a posting's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocandra.functions.detect import first_match
from vocandra.functions.text import sentences

_Y = r"(?:years?|yrs?)"
# Fixed values: (weight, pattern, kind) of the ways to ask for years; a range has two groups.
YEARS = [
    (4.0, rf"(?iu)(\d{{1,2}})\s*{_Y}?\s*(?:to|through|[-–—])\s*(\d{{1,2}})\s*{_Y}", "range"),
    (3.5, rf"(?iu)(\d{{1,2}})\s*\+\s*{_Y}", "min_plus"),
    (3.0, rf"(?iu)(?:minimum|min|at\s*least|atleast|minimum\s*of)\s*(\d{{1,2}})\s*{_Y}", "min_word"),
    (2.8, rf"(?iu)(\d{{1,2}})\s*\+?\s*{_Y}[^.\n]{{0,40}}?(?:preferred|required|expected)", "min_qualifier"),
    (
        2.5,
        rf"(?iu)(\d{{1,2}})\s*\+?\s*{_Y}\s*(?:of\s+)?(?:relevant\s+|related\s+|hands-on\s+|professional\s+|work\s+|industry\s+|total\s+|overall\s+|cumulative\s+|combined\s+|full[- ]time\s+)?(?:experience|expertise)",
        "min_experience",
    ),
    (2.2, rf"(?iu)experience[^.\n]{{0,25}}?(\d{{1,2}})\s*\+?\s*{_Y}", "min_experience_reversed"),
    (1.0, rf"(?iu)(\d{{1,2}})\s*\+?\s*{_Y}", "bare"),
]
#: What all of these need; only sentences with it are looked at.
NUMBER_OF_YEARS = rf"(?iu)\d\s*\+?\s*{_Y}"
CONTEXT = r"(?iu)experience|expertise|professional|career|worked"
MOST_YEARS = 45
DOMAINS = [
    (r"computer vision|image processing|vision model|perception|imagery", "computer_vision"),
    (r"quantiz", "quantization"),
    (r"deploy\w*|edge ai|inference|productionis|productioniz|embedded", "model_deployment"),
    (r"mlops|ml operations|machine learning operations", "mlops"),
    (r"\bnlp\b|natural language", "nlp"),
    (r"generative ai|genai|gen ai|llm|large language", "genai"),
    (r"deep learning|neural network|\bdl\b", "deep_learning"),
    (r"machine learning|\bml\b|artificial intelligence|\bai\b", "machine_learning"),
    (r"network\w*|telecom|routing|switching|\b5g\b|\blte\b", "networking"),
    (r"software (?:development|engineering)|programming|developing software", "software_engineering"),
]


def experience(text: Column) -> Column:
    """struct(min_years, max_years, kind, sentence) of the most telling mention, null without one.

    Each sentence tries each pattern once; patterns weigh by how specific they are, and 2 more where the sentence
    speaks of experience. The best weight decides, then the earlier sentence, then the earlier pattern.
    """

    def mentions(sentence: Column, at: Column) -> Column:
        bonus = F.when(sentence.rlike(CONTEXT), 2.0).otherwise(0.0)
        found = []
        for k, (weight, pattern, kind) in enumerate(YEARS):
            low = F.regexp_extract(sentence, pattern, 1).try_cast("double")
            high = F.regexp_extract(sentence, pattern, 2).try_cast("double") if kind == "range" else F.lit(None).cast("double")
            fits = low <= MOST_YEARS
            if kind == "range":
                fits = fits & (high >= low) & (high <= MOST_YEARS)
            mention = F.struct(
                (F.lit(weight) + bonus).alias("weight"), (-at).alias("sentence_no"), F.lit(-k).alias("pattern_no"),
                low.alias("min_years"), high.alias("max_years"), F.lit(kind).alias("kind"), sentence.alias("sentence"),
            )
            found.append(F.when(fits, mention))
        return F.array_compact(F.array(*found))

    told = F.filter(F.when(text.rlike(NUMBER_OF_YEARS), sentences(text)), lambda s: s.rlike(NUMBER_OF_YEARS))
    best = F.array_max(F.flatten(F.transform(told, mentions)))
    risky = (best["kind"] == "bare") & (best["weight"] < 3.0)
    return F.when(best.isNotNull() & ~risky, best)


def domain_of(*texts: Column) -> Column:
    """The first domain named in the first text that names one."""
    none = F.lit(None).cast("string")
    return F.coalesce(*[first_match(F.lower(t), DOMAINS, none) for t in texts], F.lit("general"))
