"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Everything is DataFrame functions. Features are computed inside a row, by array functions over its words. The table of
vote patterns has at most 3^rules rows, however many documents there are; EM is one expression over it, and only the
estimates (two numbers a rule) go back to the driver.

Each rule votes "bad", "good" or abstains. For a rule and a true class there is one unknown: the probability that the rule,
if it votes, votes bad. EM starts from rules that are rather right (``START``), keeps a few pseudo-votes there, and a
document is kept where the posterior of the good class is at least ``threshold``.

Null, empty and wordless texts have only zeros as features, and fail the base rule. An empty table keeps the starting
estimates. Repeated rows get equal results; other columns pass through, also under the features' names (features are read
from a struct of their own).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from wayfield.llm.store import written

WINDOW = 5
WORD = r"[^\x20\x09-\x0D]+"
#: A rule's share of bad votes among bad and among good documents at the start, and the share of bad documents.
START = (0.35, 0.02, 0.15)
PSEUDO = 20.0

#: Name, value, and the bounds: bad above ``bad``, good at most ``good``, abstain between. A negative bound turns the sense.
RULES: list[tuple[str, str, str, str]] = [
    ("symbols", "n_symbols / n_words", "value > 0.2", "value <= 0.02"),
    ("noise", "n_symbols / word_chars", "value > 0.15", "value <= 0.01"),
    ("runs", "n_runs / n_words", "value > 0.1", "value <= 0.005"),
    ("capitals", "n_upper / word_chars", "value > 0.4", "value <= 0.15"),
    ("shouting", "n_bangs / n_words", "value > 0.1", "value <= 0.01"),
    ("cells", "n_pipes / n_words", "value > 0.1", "value = 0"),
    ("repeats", "n_repeat_words / n_words", "value > 0.15", "value <= 0.02"),
    ("lines", "n_dup_lines / n_lines", "value > 0.3", "value <= 0.05"),
    ("variety", "n_distinct / n_words", "value < 0.3 and n_words < 400", "value > 0.5"),
    ("sentences", "n_words / (n_stops + 1)", "value > 60", "value <= 30"),
    ("word_length", "word_chars / n_words", "value > 12 or value < 2.5", "value between 3 and 10"),
]
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_pipes", "n_stops", "n_distinct", "n_runs"]


def with_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Struct ``d`` of the columns to ``keep`` (all, if not given), struct ``f`` of features.

    Repeats are counted by sorting window hashes, in texts that have any.
    """
    kept = F.struct(*(docs[c] for c in keep or docs.columns))
    rows = docs.select(kept.alias("d"), F.coalesce(docs[text], F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select("d", "t", lines.alias("lines"), F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    every = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("d", "t", "lines", "w", F.transform(every, lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(WINDOW)))).alias("g"))
    repeated = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i")))))
    rows = rows.select("d", "t", "lines", "w", repeated.alias("s"))
    twin = F.expr("sort_array(transform(filter(s, (x, i) -> x.g <=> get(s, i - 1).g or x.g <=> get(s, i + 1).g), x -> x.i))")
    rows = rows.select("d", "t", "lines", "w", twin.alias("p"))
    covered = F.expr(f"aggregate(transform(p, (x, i) -> least({WINDOW}, coalesce(get(p, i + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)")

    def number(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern))

    values = {
        "n_words": F.size("w"),
        "word_chars": F.length("t") - number(r"[\x20\x09-\x0D]"),
        "n_symbols": number(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("lines"),
        "n_upper": number(r"\p{Lu}"),
        "n_bangs": number("!!"),
        "n_pipes": number(r"\|"),
        "n_stops": number(r"\."),
        "n_runs": number(r"([#*$%&<>~=_+-])\1\1"),
        "n_distinct": F.size(F.array_distinct("w")),
    }
    # a row number keeps the optimiser from copying these expressions into filters and votes, where each copy runs again
    return rows.select("d", F.struct(*(v.cast("long").alias(k) for k, v in values.items()), F.monotonically_increasing_id().alias("row")).alias("f"))


def votes(features: str = "f") -> list[Column]:
    """1 bad, 0 good, null abstains; a document without words makes no vote."""
    out = []
    for name, value, bad, good in RULES:
        for f in sorted(FEATURES, key=len, reverse=True):
            value, bad = (_word(x, f, f"{features}.{f}") for x in (value, bad))
        vote = f"case when not {features}.n_words > 0 then null when {_word(bad, 'value', f'({value})')} then 1 when {_word(good, 'value', f'({value})')} then 0 end"
        out.append(F.expr(vote).alias(name))
    return out


def _word(text: str, name: str, by: str) -> str:
    import re

    return re.sub(rf"(?<![\w.]){name}\b", by, text)


@dataclass
class Estimate:
    """The share of bad documents, and for each rule its share of bad votes among bad and among good documents."""

    bad: float = START[2]
    rules: dict[str, tuple[float, float]] = field(default_factory=lambda: {r[0]: START[:2] for r in RULES})

    def posterior_bad(self, names: dict[str, str] | None = None) -> Column:
        import math

        logs = F.lit(math.log(self.bad / (1 - self.bad)))
        for rule, (in_bad, in_good) in self.rules.items():
            yes, no = math.log(in_bad / in_good), math.log((1 - in_bad) / (1 - in_good))
            column = F.col((names or {}).get(rule, rule))
            logs = logs + F.when(column == 1, F.lit(yes)).when(column == 0, F.lit(no)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logs))


def estimate(patterns: DataFrame, steps: int = 25) -> Estimate:
    """EM over vote patterns (one column a rule) and their counts ``n``.

    The patterns, 3^rules at most, become one array; all steps are one expression over it, so EM is a single job. Its
    state is an array of the share of bad documents and, rule by rule, the two shares of bad votes.
    """
    names = [r[0] for r in RULES]
    last = len(names) - 1
    one = patterns.select(F.array(*(F.coalesce(F.col(n), F.lit(2)) for n in names)).alias("v"), F.col("n").cast("double"))
    one = one.agg(F.collect_list(F.struct("v", "n")).alias("p"))
    vote = "case x.v[i] when 1 then ln(s[1 + 2 * i] / s[2 + 2 * i]) when 0 then ln((1 - s[1 + 2 * i]) / (1 - s[2 + 2 * i])) else 0D end"
    weighed = f"""transform(p, x -> named_struct('v', x.v, 'n', x.n, 'q', 1 / (1 + exp(-(
        ln(s[0] / (1 - s[0])) + aggregate(sequence(0, {last}), 0D, (a, i) -> a + {vote}))))))"""

    def total(term: str) -> str:
        return f"aggregate(w, 0D, (a, x) -> a + {term})"

    def share(q: str, start: float) -> str:
        return f"({total(f'if(x.v[i] = 1, {q}, 0D)')} + {PSEUDO * start}D) / ({total(f'if(x.v[i] < 2, {q}, 0D)')} + {PSEUDO}D)"

    bad = f"array(({total('x.n * x.q')} + {PSEUDO * START[2]}D) / ({total('x.n')} + {PSEUDO}D))"
    rules = f"flatten(transform(sequence(0, {last}), i -> array({share('x.n * x.q', START[0])}, {share('x.n * (1 - x.q)', START[1])})))"
    step = f"transform(array({weighed}), w -> concat({bad}, {rules}))[0]"
    start = f"array({START[2]}D, {', '.join(f'{START[0]}D, {START[1]}D' for _ in names)})"
    found = one.select(F.expr(f"aggregate(sequence(1, {steps}), {start}, (s, t) -> {step})")).first()[0]
    return Estimate(found[0], {n: (found[1 + 2 * i], found[2 + 2 * i]) for i, n in enumerate(names)})


def base_failed(features: str = "f") -> Column:
    return F.expr(f"{features}.n_words < 10 or 100 * {features}.n_repeat_words > 20 * {features}.n_words")


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """d (the row, or the columns to keep of it), f (features), base_failed, quality (posterior of good), kept.

    Features and votes are written once, with what is kept of the row: EM and the decisions read them.
    """
    names = [r[0] for r in RULES]
    voted = written(with_features(docs, text, keep).select("d", "f", base_failed().alias("base_failed"), *votes()), "votes")
    # base failures take no part: the method decides among the others
    found = estimate(voted.filter("not base_failed").groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    out = voted.select("d", "f", "base_failed", (1 - found.posterior_bad()).alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
