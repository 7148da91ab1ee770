"""The verification graph: documents and forms in, verdict tables out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.operators import documents, forms, pairs, review, scoring
from milaan.sources.writers import materialized


@dataclass
class Verification:
    """Lazily built tables over one set of forms and documents.

    ``keep`` writes the tables others read more than once (pair verdicts, form checks, scores) to the shared folder;
    without it they are recomputed by each table that needs them, which suits single-table queries.
    """

    answers: DataFrame
    docs: DataFrame
    today: Column = field(default_factory=F.current_date)
    keep: bool = False
    _tables: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.docs = documents.drop_form_docs(self.docs)

    def _once(self, name: str, build, keep: bool = False) -> DataFrame:
        if name not in self._tables:
            table = build()
            self._tables[name] = materialized(table, name) if keep and self.keep else table
        return self._tables[name]

    @property
    def pair_verdicts(self) -> DataFrame:
        return self._once("pair_verdicts", lambda: pairs.judged_pairs(self.docs), keep=True)

    @property
    def comparisons(self) -> DataFrame:
        if self.keep:
            return self._once("comparisons", lambda: pairs.comparisons_of(self.pair_verdicts))
        return self._once("comparisons", lambda: pairs.cross_doc_pairs(self.docs))

    @property
    def checks(self) -> DataFrame:
        return self._once("checks", lambda: forms.best_form_checks(self.answers, self.docs), keep=True)

    @property
    def validated(self) -> DataFrame:
        return self._once("validated", lambda: forms.validate_answers(self.answers, self.today))

    @property
    def voted(self) -> DataFrame:
        return self._once("voted", lambda: pairs.majority_vote(self.pair_verdicts))

    @property
    def blocker_counts(self) -> DataFrame:
        return self._once("blocker_counts", lambda: pairs.blocker_counts(self.voted))

    @property
    def primary(self) -> DataFrame:
        return self._once("primary", lambda: pairs.primary_blocker(self.blocker_counts))

    @property
    def summary(self) -> DataFrame:
        return self._once("summary", lambda: pairs.verdict_summary(self.comparisons))

    @property
    def scores(self) -> DataFrame:
        return self._once(
            "scores", lambda: scoring.case_scores(self.answers, self.docs, self.checks, self.validated), keep=True
        )

    @property
    def issues(self) -> DataFrame:
        return self._once("issues", lambda: scoring.field_issues(self.validated, self.checks))

    @property
    def accuracy(self) -> DataFrame:
        return self._once("accuracy", lambda: scoring.doc_accuracy(self.docs, self.comparisons, self.checks))

    @property
    def remediation(self) -> DataFrame:
        return review.remediation_route(self.answers, self.primary)

    @property
    def audit(self) -> DataFrame:
        return review.audit_rows(self.answers, self.docs, self.summary, self.primary, self.checks, self.comparisons)

    @property
    def packs(self) -> DataFrame:
        return review.result_packs(self.answers, self.docs, self.scores, self.issues)

    @property
    def impact(self) -> DataFrame:
        return scoring.case_impact(self.summary, self.scores)

    @property
    def verdicts(self) -> DataFrame:
        """One row per case: pair counts, score, grade, readiness and where to go."""
        route = self.remediation.select("case_id", "service_id", "primary_doc", "blocker_count", "portal_name", "portal_url", "how")
        scores = self.scores.select("case_id", "service_id", "score", "grade", "ready_for_portal")
        counts = ["matches", "variants", "blockers", "uncertain"]
        return (
            route.join(scores, ["case_id", "service_id"])
            .join(self.summary, "case_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
        )
