"""Settings for cleaning, scoring, anomaly detection and decisions."""

from __future__ import annotations

from dataclasses import dataclass, field

from tablegauge import fixed


@dataclass(frozen=True)
class CleanConfig:
    """Settings shared by both rule sets.

    ``fill_number=None`` leaves missing numbers missing, so completeness sees
    them. ``date_formats`` are tried in order, and a value that fits none of them
    is a parse error; without any, each column's form is found by a vote of its
    values (``functions.dates``), and values of another form are errors.
    """

    fill_text: str = "UNKNOWN"
    fill_number: float | None = 0.0
    min_amount: float = 0.0
    max_amount: float = 10_000_000.0
    outlier_threshold: float = 3.0
    duplicate_keys: tuple[str, ...] = ()
    date_formats: tuple[str, ...] = ()
    #: few rows are duplicates: exchange only those that may be (``dedup.keep_first``)
    rare_duplicates: bool = False
    #: count a custom ``fill_text`` as a placeholder when scoring completeness
    fill_is_placeholder: bool = False


@dataclass(frozen=True)
class InvoiceConfig(CleanConfig):
    """Settings of the fixed-schema (invoice) rule set."""

    duplicate_keys: tuple[str, ...] = ("vendor_name", "invoice_number")
    date_columns: tuple[str, ...] = ("invoice_date", "due_date", "payment_date")
    amount_columns: tuple[str, ...] = ("amount", "tax_amount", "total_amount")
    currencies: tuple[str, ...] = ("USD", "EUR", "GBP", "AUD", "CAD", "INR", "SGD")
    statuses: tuple[str, ...] = ("PAID", "PENDING", "OVERDUE", "CANCELLED", "DRAFT")


@dataclass(frozen=True)
class Roles:
    """Columns by semantic type, in table order; ``forms`` has the date patterns of
    columns whose values were looked at."""

    types: dict[str, str] = field(default_factory=dict)
    forms: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _of(self, kind: str) -> list[str]:
        return [c for c, t in self.types.items() if t == kind]

    @property
    def dates(self) -> list[str]:
        return self._of("date")

    @property
    def numerics(self) -> list[str]:
        return self._of("numeric")

    @property
    def ids(self) -> list[str]:
        return self._of("id")

    @property
    def categories(self) -> list[str]:
        return self._of("categorical")

    @property
    def texts(self) -> list[str]:
        return self._of("text")

    @property
    def booleans(self) -> list[str]:
        return self._of("boolean")

    @property
    def critical(self) -> list[str]:
        """Columns whose absence counts against completeness."""
        return self.ids[:3] + self.numerics[:3] + self.categories[:3]

    def by_role(self) -> dict[str, list[str]]:
        return {
            "date_columns": self.dates,
            "numeric_columns": self.numerics,
            "id_columns": self.ids,
            "categorical_columns": self.categories,
            "text_columns": self.texts,
            "boolean_columns": self.booleans,
            "critical_fields": self.critical,
        }


@dataclass(frozen=True)
class Policy:
    """Decision policy: the defaults overlaid by ``overrides``."""

    overrides: dict[str, float] = field(default_factory=dict)

    def targets(self) -> dict[str, float]:
        return {**fixed.DEFAULT_POLICY, **self.overrides}
