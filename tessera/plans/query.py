"""A chainable query builder over a DataFrame: each call adds to the logical plan, Catalyst does the rest."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from contextlib import redirect_stdout
from functools import reduce
from io import StringIO
from itertools import groupby
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import merge
from tessera.operators.relational import single

WORD = r"[^\p{L}\p{N}]+"


def _array(values: Sequence) -> Column:
    return F.array(*map(F.lit, values))


def tokens(query: str) -> list[str]:
    """The words of a search, cut as those of the texts are."""
    return ["".join(g) for letters, g in groupby(query.lower(), str.isalnum) if letters]


def word_line(column: Column) -> Column:
    """A text's words, each between spaces: made once, however many words and phrases are looked for in it."""
    words = F.filter(F.split(F.lower(column), WORD), lambda w: w != "")
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def text_match(column: Column, query: str, kind: str = "plain") -> Column:
    """Full-text match without stemming. plain: all words; phrase: in order, next to each other; any: one word at least;
    websearch: all words and quoted phrases, but none of those with a minus before them, where "or" parts alternatives; raw: words joined
    by & and | (& first), ! before those that must not be there."""
    line = word_line(column)
    return matched(lambda words: F.contains(line, F.lit(f" {' '.join(words)} ")), query, kind)


def matched(phrase: Callable[[list[str]], Column], query: str, kind: str = "plain") -> Column:
    """The condition that a search means; phrase says whether words stand next to each other in a text."""
    has = lambda said: phrase(tokens(said)) if tokens(said) else F.lit(True)
    every = lambda parts: reduce(and_, parts, F.lit(True))
    if kind == "phrase":
        return has(query)
    if kind == "any":
        return reduce(or_, map(has, tokens(query)), F.lit(False))
    if kind == "websearch":
        ways: list[list[Column]] = [[]]
        for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
            if word.lower() == "or" and not minus:
                ways.append([])
            elif tokens(quoted or word):
                ways[-1].append(~has(quoted or word) if minus else has(quoted or word))
        return reduce(or_, [every(w) for w in ways if w] or [F.lit(True)])
    if kind == "raw":
        one = lambda w: ~has(w) if w.strip().startswith("!") else has(w)
        return reduce(or_, [every(map(one, way.split("&"))) for way in query.split("|")])
    return every(map(has, tokens(query)))


def contains(c: Column, v: object) -> Column:
    """Whether the column holds the value: all items of a list, all pairs of a dictionary (column: JSON text), a part of a text."""
    if isinstance(v, dict):
        return reduce(and_, [F.get_json_object(c, f"$.{k}").eqNullSafe(F.lit(json.dumps(x) if isinstance(x, (bool, dict, list)) else str(x))) for k, x in v.items()], c.isNotNull())
    return F.contains(c, F.lit(v)) if isinstance(v, str) else F.size(F.array_except(_array(v), c)) == 0


OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "like_all": lambda c, v: reduce(and_, [c.like(p) for p in v]),
    "like_any": lambda c, v: reduce(or_, [c.like(p) for p in v]),
    "ilike_all": lambda c, v: reduce(and_, [c.ilike(p) for p in v]),
    "ilike_any": lambda c, v: reduce(or_, [c.ilike(p) for p in v]),
    "is": lambda c, v: c.isNull() if v is None else c.eqNullSafe(F.lit(v)),
    "in": lambda c, v: c.isin(list(dict.fromkeys(v))),
    "contains": contains,
    "contained_by": lambda c, v: F.size(F.array_except(c, _array(v))) == 0,
    "overlaps": lambda c, v: F.arrays_overlap(c, _array(v)),
    # ranges are structs (lo, hi), half open
    "range_gt": lambda c, v: c["lo"] >= v[1],
    "range_gte": lambda c, v: c["lo"] >= v[0],
    "range_lt": lambda c, v: c["hi"] <= v[0],
    "range_lte": lambda c, v: c["hi"] <= v[1],
    "range_adjacent": lambda c, v: (c["hi"] == v[0]) | (c["lo"] == v[1]),
    "fts": lambda c, v: text_match(c, v),
    "phfts": lambda c, v: text_match(c, v, "phrase"),
    "wfts": lambda c, v: text_match(c, v, "websearch"),
    "rfts": lambda c, v: text_match(c, v, "raw"),
}


def condition(column: str, operator: str, value: object, negate: bool = False) -> Column:
    """A filter by the operator's name; negated in three-valued logic."""
    out = OPERATORS[operator](F.col(column), value)
    return ~out if negate else out


def combined(said: tuple) -> Column:
    """A condition (column, operator, value), or ("and" | "or", condition, ...) or ("not", condition), nested as deep as wanted."""
    if said[0] == "not":
        return ~combined(said[1])
    if said[0] in ("and", "or"):
        return reduce(and_ if said[0] == "and" else or_, map(combined, said[1:]))
    return condition(*said)


class Query:
    """Immutable: every call returns a new query. Ordering keys add up and are applied with limits at the end."""

    def __init__(self, df: DataFrame, keys: tuple[Column, ...] = (), first: int = 0, most: int | None = None, whole: DataFrame | None = None, kept: tuple[Column, ...] = ()) -> None:
        self.df, self.keys, self.first, self.most = df, keys, first, most
        #: The table before any filter, and the filters: what a change of the table goes by.
        self.whole, self.kept = df if whole is None else whole, kept

    def _with(self, **changes: object) -> Query:
        return Query(**({"df": self.df, "keys": self.keys, "first": self.first, "most": self.most, "whole": self.whole, "kept": self.kept} | changes))

    def _filtered(self, kept: Column) -> Query:
        return self._with(df=self.df.filter(kept), kept=(*self.kept, kept))

    def where(self, column: str, operator: str, value: object) -> Query:
        return self._filtered(condition(column, operator, value))

    def where_not(self, column: str, operator: str, value: object) -> Query:
        return self._filtered(condition(column, operator, value, negate=True))

    def where_any(self, *conditions: tuple) -> Query:
        """A disjunction of conditions, each as combined() takes it."""
        return self._filtered(combined(("or", *conditions)))

    def match(self, **values: object) -> Query:
        return self._filtered(reduce(and_, [F.col(c) == v for c, v in values.items()]))

    # changes: each returns the whole table as it is afterwards

    def _hit(self) -> Column:
        """Whether a row passes all filters; a change without a filter, or after a limit, is refused."""
        if not self.kept or self.most is not None or self.first:
            raise ValueError("a change needs filters, and no limit or range")
        return F.coalesce(reduce(and_, self.kept), F.lit(False))

    def update(self, most: int | None = None, **values: object) -> DataFrame:
        """The rows that pass get values (Columns or plain ones); most: ValueError if more rows would be changed."""
        hit = self._hit()
        if most is not None:
            merge.guarded(self.df, most)
        return merge.update_where(self.whole, hit, {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()})

    def delete(self, most: int | None = None) -> DataFrame:
        """Without the rows that pass."""
        hit = self._hit()
        if most is not None:
            merge.guarded(self.df, most)
        return self.whole.filter(~hit)

    def insert(self, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
        return merge.insert(self.whole, rows, defaults)

    def upsert(self, rows: DataFrame, on: str, ignore_duplicates: bool = False) -> DataFrame:
        return merge.upsert(self.whole, rows, on, ignore_duplicates)

    def order(self, column: str, ascending: bool = True, nulls_first: bool | None = None) -> Query:
        """Nulls last when ascending and first when descending, unless told otherwise."""
        first = not ascending if nulls_first is None else nulls_first
        c = F.col(column)
        key = (c.asc_nulls_first() if first else c.asc_nulls_last()) if ascending else (c.desc_nulls_first() if first else c.desc_nulls_last())
        return self._with(keys=(*self.keys, key))

    def limit(self, n: int) -> Query:
        return self._with(most=n)

    def range(self, first: int, last: int) -> Query:
        """Rows first to last, both included, from 0."""
        return self._with(first=first, most=last - first + 1)

    def select(self, *columns: str) -> Query:
        """A projection; applied after the order, so a key need not be among the columns."""
        return self._with(df=self.frame().select(*columns), keys=(), first=0, most=None) if self.keys or self.most is not None or self.first else self._with(df=self.df.select(*columns))

    def frame(self) -> DataFrame:
        out = self.df.orderBy(*self.keys) if self.keys else self.df
        out = out.offset(self.first) if self.first else out
        return out if self.most is None else out.limit(self.most)

    def single(self) -> dict:
        return single(self.frame())

    def maybe_single(self) -> dict | None:
        return single(self.frame(), allow_none=True)

    def count(self) -> int:
        return self.df.count()

    def explain(self, mode: str = "formatted") -> str:
        """The plan as text."""
        with redirect_stdout(StringIO()) as said:
            self.frame().explain(mode)
        return said.getvalue()


class Functions:
    """Functions that are called by name: each makes a table of named arguments."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, function: Callable[..., DataFrame]) -> None:
        self._known[name] = function

    def call(self, name: str, **arguments: object) -> Query:
        """The result of a function, to be filtered and ordered further; KeyError for an unknown name."""
        return Query(self._known[name](**arguments))
