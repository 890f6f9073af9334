"""Match rules: data in, column expressions out."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlink.functions import keys, similarity, text

DEFAULT_PRIORITY = 999
LEVENSHTEIN = "levenshtein"
METHODS = ("", "token_sort", LEVENSHTEIN)


@dataclass(frozen=True)
class Condition:
    field: str
    percentage: float = 0.0
    include: bool = True
    blank: bool = False
    blank_allowed: bool = False
    #: How texts are compared: by token sort ratio, or LEVENSHTEIN.
    method: str = ""


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: tuple[Condition, ...]
    match_reason: str
    priority: int = DEFAULT_PRIORITY
    enabled: bool = True
    name: str = ""
    position: int = field(default=0, compare=False)


# The two rules in force when the user gives none.
DEFAULT_RULES = {
    "rules": {
        "BR001": {
            "name": "Company + Address",
            "priority": 100,
            "match_reason": "CMP_ADDR",
            "conditions": [
                {"field": "COMPANY_NAME", "percentage": "70"},
                {"field": "ADDRESS_LINE_1", "percentage": "80"},
                {"field": "ADDRESS_LINE_2", "percentage": "80", "blank_allowed": True},
                {"field": "ZIP_CODE", "percentage": "100"},
            ],
        },
        "BR002": {
            "name": "Company Name + Phone + BlankAddress",
            "priority": 200,
            "match_reason": "CMP_PHN_BLNK_ADDR",
            "conditions": [
                {"field": "COMPANY_NAME", "percentage": "60"},
                {"field": "PHONE_NUMBER", "percentage": "100"},
                {"field": "ADDRESS_LINE_1", "percentage": "", "blank": True},
                {"field": "ZIP_CODE", "percentage": "", "blank": True},
            ],
        },
    }
}

# Default thresholds of fields, with their blank handling.
FIELD_THRESHOLDS = {
    "company_name": {"value": 80.0, "allow_blank": False},
    "address1": {"value": 80.0, "allow_blank": False},
    "address2": {"value": 90.0, "allow_blank": True},
    "city": {"value": 85.0, "allow_blank": False},
    "state": {"value": 100.0, "allow_blank": False},
    "zip_code": {"value": 100.0, "allow_blank": False},
    "zip_supp": {"value": 100.0, "allow_blank": True},
    "email": {"value": 100.0, "allow_blank": False},
    "phone": {"value": 100.0, "allow_blank": False},
}
THRESHOLD_OF_FIELD = {
    "COMPANY_NAME": "company_name",
    "ADDRESS_LINE_1": "address1",
    "ADDRESS_LINE_2": "address2",
    "CITY": "city",
    "STATE": "state",
    "ZIP_CODE": "zip_code",
    "ZIP4": "zip_supp",
    "EMAIL_ADDRESS": "email",
    "PHONE_NUMBER": "phone",
}


def parse_rules(
    document: Mapping[str, Any], thresholds: Mapping[str, Mapping[str, Any]] | None = None
) -> list[Rule]:
    """Rules in file order from ``{"rules": {id: rule}}``.

    A percentage that is no number raises here, before any data is read. With
    ``thresholds`` a condition that lacks ``percentage`` takes its field's threshold and
    blank handling from there; without, it means 0.
    """
    rules = []
    for position, (rule_id, body) in enumerate((document.get("rules") or {}).items()):
        conditions = []
        for entry in body.get("conditions", []):
            name = entry.get("field", "")
            raw, blank_allowed = entry.get("percentage"), bool(entry.get("blank_allowed", False))
            fallback = (thresholds or {}).get(THRESHOLD_OF_FIELD.get(name, name.lower()))
            if raw is None and fallback is not None:
                raw = fallback["value"]
                blank_allowed = blank_allowed or bool(fallback.get("allow_blank", False))
            try:
                percentage = float(raw or 0)
            except ValueError as error:
                raise ValueError(f"rule {rule_id}, field {name}: percentage {raw!r} is no number") from error
            if (method := entry.get("method") or "") not in METHODS:
                raise ValueError(f"rule {rule_id}, field {name}: unknown method {method!r}")
            conditions.append(
                Condition(name, percentage, bool(entry.get("include", True)), bool(entry.get("blank", False)), blank_allowed, method)
            )
        rules.append(
            Rule(
                rule_id,
                tuple(conditions),
                body.get("match_reason", rule_id),
                int(body.get("priority", DEFAULT_PRIORITY)),
                bool(body.get("enabled", True)),
                body.get("name", ""),
                position,
            )
        )
    return rules


def default_rules() -> list[Rule]:
    return parse_rules(DEFAULT_RULES)


def load_json(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """A configuration document, or None if there is no such file. Bad JSON raises."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).take(1)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return None
        raise
    return json.loads(rows[0][0]) if rows else None


def load_rules(spark: SparkSession, path: str, **options: Any) -> list[Rule]:
    """Rules of a JSON file; no file means no rules."""
    return parse_rules(load_json(spark, path) or {}, **options)


def active_rules(rules: Iterable[Rule]) -> list[Rule]:
    """Enabled rules with conditions, best first: by priority, then file order."""
    usable = [r for r in rules if r.enabled and r.conditions]
    return sorted(usable, key=lambda r: (r.priority, r.position))


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (r.id, r.name, r.enabled, r.priority, r.match_reason, r.position,
         [(c.field, c.percentage, c.include, c.blank, c.blank_allowed) for c in r.conditions])
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "id string, name string, enabled boolean, priority int, match_reason string, position int, "
        "conditions array<struct<field:string,percentage:double,include:boolean,blank:boolean,blank_allowed:boolean>>",
    )


# --- comparators ---------------------------------------------------------------------

FUZZY = ("company", "address", "text")


def comparator(name: str, for_score: bool = False, strict_email: bool = False) -> str:
    """Kind of comparison for a field, by the first test its name passes.

    The order is part of the semantics: EMAIL_ADDRESS is an address unless
    ``strict_email``; a name such as CONTACT_NAME is decided as a company but its score
    is recorded as plain text.
    """
    upper = name.upper()
    if strict_email and "EMAIL" in upper:
        return "email"
    if "COMPANY" in upper or ("NAME" in upper and not for_score):
        return "company"
    for kind in ("ADDRESS", "PHONE", "EMAIL"):
        if kind in upper:
            return kind.lower()
    return "text"


_CLEAN = {
    "company": lambda c: text.sorted_words(text.company_std(c)),
    "address": lambda c: text.sorted_words(text.address_std(c)),
    "phone": text.phone_std,
    "email": text.email_std,
    "text": text.token_sort,
}


#: Columns of a standardised record that hold a field's clean value, and what comparing does to it besides.
_STANDARD = {
    ("COMPANY_NAME", "company"): ("COMPANY_NAME_STD", text.sorted_words),
    ("ADDRESS_LINE_1", "address"): ("ADDRESS1_STD", text.sorted_words),
    ("ADDRESS_LINE_2", "address"): ("ADDRESS2_STD", text.sorted_words),
    ("PHONE_NUMBER", "phone"): ("PHONE_STD", lambda c: c),
    ("EMAIL_ADDRESS", "email"): ("EMAIL_STD", lambda c: c),
}


def comparable(value: Column, kind: str) -> Column:
    """The form in which a value is compared; null if the raw value is blank."""
    return F.when(~text.is_blank(value), _CLEAN[kind](value))


class RuleSet:
    """Active rules compiled for one pair of record sides.

    ``columns`` names the comparison columns a record needs, so that cleaning and token
    sorting happen once per record and not once per pair.
    """

    def __init__(self, rules: Iterable[Rule], strict_email: bool = False):
        self.rules = active_rules(rules)
        self.strict_email = strict_email
        self.columns: dict[tuple[str, str], str] = {}
        for rule in self.rules:
            for c in rule.conditions:
                for score in (False, True):
                    self.columns.setdefault((c.field, self.kind(c.field, score)), f"c{len(self.columns)}")
        self.score_fields = list(dict.fromkeys(c.field for r in self.rules for c in r.conditions))

    def kind(self, name: str, for_score: bool = False) -> str:
        return comparator(name, for_score, self.strict_email)

    def name(self, c: Condition, for_score: bool = False) -> str:
        return self.columns[c.field, self.kind(c.field, for_score)]

    def record_columns(self, df: DataFrame, standardised: bool = False) -> dict[str, Column]:
        """Comparison columns; those of a ``standardised`` record are not cleaned a second time."""
        out = {}
        for (name, kind), alias in self.columns.items():
            raw = keys.field(df, name)
            clean, finish = _STANDARD.get((name, kind), (None, None))
            if standardised and clean in df.columns:
                out[alias] = F.when(~text.is_blank(raw), finish(F.col(clean)))
            else:
                out[alias] = comparable(raw, kind)
        return out

    # One record -----------------------------------------------------------------

    def eligible(self, rule: Rule, side: str = "") -> Column:
        """True if the record alone does not rule itself out."""
        tests = []
        for c in rule.conditions:
            value = F.col(side + self.name(c))
            if c.blank:
                tests.append(value.isNull())
            elif c.include and c.percentage > 0 and not c.blank_allowed:
                # A value that cleans to '' scores 0 against anything.
                tests.append(F.coalesce(value != "", F.lit(False)))
            elif not c.blank_allowed:
                tests.append(value.isNotNull())
        return reduce(and_, tests, F.lit(True))

    def accepts_copy(self, rule: Rule) -> Column:
        """True if the record would match an exact copy of itself."""
        tests = []
        for c in rule.conditions:
            value = F.col(self.name(c))
            score = F.when(value != "", 100.0).otherwise(0.0)
            if c.blank:
                tests.append(value.isNull())
            else:
                test = (score >= c.percentage) if c.include else (score < c.percentage)
                tests.append(F.when(value.isNotNull(), test).otherwise(F.lit(c.blank_allowed)))
        return reduce(and_, tests, F.lit(True))

    def profile(self, rule: Rule) -> Column:
        """Text that is equal exactly for records the rule cannot tell apart."""
        names = list(dict.fromkeys(self.name(c, s) for c in rule.conditions for s in (False, True)))
        return F.to_json(F.struct(*names))

    def bag_columns(self, rule: Rule) -> dict[str, Column]:
        """Columns ``bag0_*``, ``bag1_*`` that let ``possible`` reject pairs without LCS."""
        out = {}
        for name in self.lcs_columns([rule]):
            for i, bag in enumerate(similarity.bag_signature(F.col(name))):
                out[f"bag{i}_{name}"] = bag
        return out

    def any_eligible(self, side: str = "") -> Column:
        return reduce(or_, (self.eligible(r, side) for r in self.rules), F.lit(False))

    def equal_columns(self, rule: Rule) -> list[str]:
        """Columns on which two records must agree for the rule: extra keys of its join."""
        return list(
            dict.fromkeys(
                self.name(c)
                for c in rule.conditions
                if c.include and not c.blank and not c.blank_allowed
                and (c.percentage == 100 or (c.percentage > 0 and self.kind(c.field) not in FUZZY))
            )
        )

    # Two records ----------------------------------------------------------------

    def needs_lcs(self, rule: Rule, c: Condition, for_score: bool = False) -> bool:
        """Whether the exact similarity of the condition must be computed."""
        if self.by_edits(c, for_score):
            return False
        if c.blank or self.kind(c.field, for_score) not in FUZZY:
            return False
        return not (c.include and c.percentage >= 100 and self.kind(c.field, True) == self.kind(c.field))

    def by_edits(self, c: Condition, for_score: bool = False) -> bool:
        """Whether the condition compares texts by Levenshtein distance, which Spark has itself."""
        return c.method == LEVENSHTEIN and self.kind(c.field, for_score) in FUZZY

    def lcs_columns(self, rules: Iterable[Rule]) -> list[str]:
        return list(
            dict.fromkeys(
                self.name(c, s) for r in rules for c in r.conditions for s in (False, True) if self.needs_lcs(r, c, s)
            )
        )

    def _test(self, rule: Rule, c: Condition, left: str, right: str, exact: bool, bags: bool = False) -> Column:
        name = self.name(c)
        a, b = F.col(left + name), F.col(right + name)
        if c.blank:
            return a.isNull() & b.isNull()
        both = a.isNotNull() & b.isNotNull()
        if self.by_edits(c) or self.kind(c.field) not in FUZZY:
            score = similarity.levenshtein_similarity(a, b) if self.by_edits(c) else similarity.exact_score(a, b)
            test = (score >= c.percentage) if c.include else (score < c.percentage)
        elif c.include and c.percentage >= 100:
            test = (a == b) & (a != "") if c.percentage == 100 else F.lit(False)
        elif exact:
            score = F.col(f"sim_{name}")
            test = (score >= c.percentage) if c.include else (score < c.percentage)
        elif c.include and c.percentage > 0:
            # 1e-6 keeps rounding of the bound from rejecting what the score accepts.
            test = similarity.length_bound(a, b) >= c.percentage - 1e-6
            if bags:
                sides = [(F.col(f"{left}bag{i}_{name}"), F.col(f"{right}bag{i}_{name}")) for i in (0, 1)]
                test = test & (similarity.bag_bound(a, b, sides) >= c.percentage - 1e-6)
        else:
            test = F.lit(True)
        return F.when(both, test).otherwise(F.lit(c.blank_allowed))

    def possible(self, rule: Rule, left: str, right: str, bags: bool = False) -> Column:
        """Necessary condition of a match without LCS, cheapest tests first."""
        cheap_first = sorted(rule.conditions, key=lambda c: (not c.blank, self.needs_lcs(rule, c)))
        return reduce(and_, (self._test(rule, c, left, right, exact=False, bags=bags) for c in cheap_first))

    def with_similarities(self, pairs: DataFrame, rules: list[Rule], left: str, right: str) -> DataFrame:
        """Add columns ``sim_<column>`` of every fuzzy comparison the rules ask for.

        For a single rule the conditions are computed one after the other and failing
        pairs are dropped in between; several rules share one trip to Python.
        """
        names = self.lcs_columns(rules)
        if len(rules) > 1 or len(names) < 2:
            return self._similarities(pairs, names, left, right)
        for name in names:
            pairs = self._similarities(pairs, [name], left, right)
            for c in rules[0].conditions:
                if self.name(c) == name and self.needs_lcs(rules[0], c):
                    pairs = pairs.filter(self._test(rules[0], c, left, right, exact=True))
        return pairs

    @staticmethod
    def _similarities(pairs: DataFrame, names: list[str], left: str, right: str) -> DataFrame:
        if not names:
            return pairs
        sides = [(F.col(left + n), F.col(right + n)) for n in names]
        return pairs.withColumn("_lcs", similarity.lcs_lengths_of(sides)).withColumns(
            {
                f"sim_{n}": similarity.indel_ratio(a, b, F.col(f"_lcs.lcs{i}"))
                for i, (n, (a, b)) in enumerate(zip(names, sides))
            }
        )

    def matches(self, rule: Rule, left: str, right: str) -> Column:
        """The rule's verdict on a pair that carries its similarities."""
        return reduce(and_, (self._test(rule, c, left, right, exact=True) for c in rule.conditions))

    def scores(self, rule: Rule, left: str, right: str) -> dict[str, Column]:
        """Scores recorded for a pair the rule matched; null where a value is blank."""
        out = {}
        for c in rule.conditions:
            name = self.name(c, for_score=True)
            a, b = F.col(left + name), F.col(right + name)
            if self.by_edits(c, for_score=True):
                score = F.lit(None).cast("double") if c.blank else similarity.levenshtein_similarity(a, b)
            elif self.kind(c.field, True) not in FUZZY:
                score = similarity.exact_score(a, b)
            elif c.blank or self.needs_lcs(rule, c, for_score=True):
                # A condition that demands blanks has no values to score.
                score = F.lit(None).cast("double") if c.blank else F.col(f"sim_{name}")
            else:
                score = F.lit(100.0)
            out[c.field] = F.when(a.isNotNull() & b.isNotNull(), score)
        return out
