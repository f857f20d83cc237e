"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from regular expressions.  Five labelers vote on each: the strict form, a
check of its value, a gazetteer of known words, the words before it, and words that speak
against it.  Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is, and a logistic span classifier is trained on the expected labels.  The counts
come from all documents; there are at most kinds x 2^labelers of them, so the driver
fits on a table of bounded size.

The base kinds (email, ip, card, phone) are fixed by rule and always reported; the method adds
`national` (phone numbers without a plus), `ssn`, `secret` (tokens and keys) and `name` spans where
the classifier accepts them and no base span overlaps.

Patterns are written so that matching is linear: possessive, and entered only where a run begins.
Places of matches are sums over blocks of `BLOCK` matches, and overlaps are looked for by blocks, so a
long text with very many matches doesn't cost their square.  Candidates and their votes are
found once and written to the shared folder; patterns are counted and spans accepted from there.

Offsets count code points, the end is exclusive.  Defined results: null and empty texts
have no spans; repeated rows get equal results; an empty table gives an empty result; extra columns
are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stash, table

#: Patterns of the base kinds, equal in what they match to the rule's.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of digits with single separators are matched whole or not at all, so only those of 16 to 19 digits need a look
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Given and family names that are frequent in the four languages of the texts, and forms of address.
GIVEN = "Alice Ana Andrea Andreas Anna Antoine Antonio Barbara Bernd Brigitte Camille Carlos Carmen Catherine Charles Christine Claire Claudia Daniel David Elena Elizabeth Emily Emma Eva Fernando Francisco François Frank George Hans Heinz Isabel Jack James Javier Jean Jennifer Jessica John Jorge José Joseph Juan Julia Julie Jürgen Karen Karin Karl Kevin Klaus Laura Linda Lisa Louis Lucas Luis Manuel Marco María Maria Marie Mark Martin Mary Matthew Michael Michel Miguel Monika Nathalie Nicolas Olivia Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Ramón Richard Robert Rosa Sabine Sandra Sarah Sofia Stefan Stephen Susan Thomas Ursula Victoria William Wolfgang".split()
FAMILY = "Anderson Bauer Becker Bernard Bonnet Brown Clark Davis Díaz Dubois Durand Fernández Fischer García Garcia Gómez González Hernández Hoffmann Johnson Jones Klein Koch Lambert Laurent Lefebvre Leroy Lewis López Lopez Martin Martínez Meyer Miller Moore Moreau Moreno Müller Muñoz Pérez Petit Ramírez Richter Robert Rodríguez Roux Sánchez Schäfer Schmidt Schneider Schröder Schulz Simon Smith Taylor Thomas Torres Wagner Weber White Williams Wilson Wolf".split()
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor|Sra|Sr"
#: How keys of well-known services begin.
KEYS = r"AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|sk_|pk_live_|pk_|npm_|hf_"
_NAMED = r"(?i:token|secret|key|password|passwd|api)\s{0,4}[=:]"
#: Candidates of the method's own kinds, and the strict form that the first labeler votes by.
MORE = {
    "national": (r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9-])[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9-])", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    # long runs; from 16 characters on, however long, what has a known prefix or stands after a word of the context
    "secret": (r"(?<![A-Za-z0-9+/_-])(?:[0-9a-f]{32,64}|[A-Za-z0-9_-]{40,64}|(?:AKIA|ASIA)[A-Za-z0-9+/_-]{12,}+|(?=(?:" + KEYS + r")[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
               r"|(?<=" + _NAMED + r"\s{0,4}[\"'`]?)[A-Za-z0-9+/_-]{16,}+)(?![A-Za-z0-9+/_-])", r"^(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36})$"),
    "name": (r"(?=\p{Lu})(?<!\p{L})(?:(?:" + TITLES + r")\.? \p{Lu}\p{Ll}{1,20}(?: \p{Lu}\p{Ll}{1,20})?|(?:" + "|".join(GIVEN) + r") \p{Lu}\p{Ll}{1,20})(?!\p{L})", r"^\p{L}+\. "),
}
#: By kind: what a gazetteer knows (prefixes of issued numbers and keys, names), and what stands before.
KNOWN = {
    "national": r"^\(?[2-9][0-8][0-9]",
    "ssn": r"^(?:00[1-9]|0[1-9]|[1-57]|6[0-57-9]|66[0-57-9])",
    "secret": r"^(?:" + KEYS + r"|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$)",
    "name": r"(?:^| )(?:" + "|".join([*GIVEN, *FAMILY]) + r")(?: |$)",
}
CONTEXT = {
    "national": r"(?i)(?:call|phone|tel|telephone|mobile|cell|fax|contact|number|telefon|mobil|anrufen|appel(?:ez)?|téléphone|portable|llame|teléfono|móvil)\W*$",
    "ssn": r"(?i)(?:ssn|social|social security|security number|sozialversicherung\p{L}*|sécurité sociale|seguridad social)\W*$",
    "secret": _NAMED + r"\s*\W?$",
    "name": r"(?i)(?:contact|dear|by|from|with|ask for|name|signed|regards|liebe|lieber|von|herrn|cher|chère|par|estimad[oa]|por|de)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|part|model|commit|sha1|sha256|md5|checksum|\$|€)\W*$"
LABELERS = ["strict", "value", "known", "context", "against"]
#: Pseudo-votes behind the rates that EM starts from.
ACCEPT, BEFORE, BLOCK, PRIOR_VOTES = 0.5, 24, 128, 8.0
KINDS = [*BASE, *MORE]
_SPAN = "array<struct<kind:string,start:int,stop:int,hit:string,before:string>>"


def _blocks(rows: Column) -> Column:
    """An array that isn't empty as one of blocks."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))


def _steps(pattern: str, hint: str, text: Column) -> Column:
    """Each match with its length, that of the text between it and the one before, and what that ends with; none in texts without what every match has."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(hits, F.split(text, pattern, -1), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g"), F.length(h).alias("n"), F.substring(g, -BEFORE, BEFORE).alias("b")))
    return F.when(text.rlike(hint), F.filter(steps, lambda x: x["h"].isNotNull()))


def _spans(kind: str, steps: Column) -> Column:
    """Matches with their places: lengths are added up in blocks and then over blocks.  `steps` is a column that exists."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["n"]).alias("stop"), x["h"].alias("hit"), x["b"].alias("before")))).alias("out")))

    def shifted(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + acc["at"]).alias("start"), (x["stop"] + acc["at"]).alias("stop"), x["hit"].alias("hit"), x["before"].alias("before")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(F.size(steps) > 0, F.flatten(F.aggregate(F.transform(_blocks(steps), within), whole, shifted)["out"])).otherwise(F.array().cast(_SPAN))


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that go through a generator, so the optimizer doesn't write them out where they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _bounded(spans: Column) -> Column:
    """Spans in blocks, each with its first start and last end."""
    return F.when(F.size(spans) > 0, F.transform(_blocks(spans), lambda b: F.struct(
        F.array_min(b["start"]).alias("lo"), F.array_max(b["stop"]).alias("hi"), b.alias("spans"))))


def _meets(blocks: Column, c: Column, also=lambda b: F.lit(True)) -> Column:
    """Does a span of the blocks overlap `c`?"""
    return F.coalesce(F.exists(blocks, lambda x: (x["lo"] < c["stop"]) & (c["start"] < x["hi"]) & F.exists(
        x["spans"], lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]) & also(b))), F.lit(False))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less nine if that is over nine."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(x: Column) -> Column:
    """Does a base match pass the rule of its kind?"""
    hit = x["hit"]
    n = F.length(_digits(hit))
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    octets = F.forall(F.split(hit, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    card = n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(hit))).otherwise(False)
    return (F.when(x["kind"] == "email", True).when(x["kind"] == "ip", octets)
            .when(x["kind"] == "card", card).otherwise(n.between(8, 15)))


#: What a text must have to be searched for a kind.
HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]",
    "national": r"[0-9]{3}[\x20.-][0-9]{4}", "ssn": r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}", "secret": r"[A-Za-z0-9_-]{32}|(?:" + KEYS + r")[A-Za-z0-9+/_-]{12}|" + _NAMED, "name": r"\p{Ll}\.? \p{Lu}\p{Ll}",
}


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with _base (valid base spans by kind, then start) and _more (candidates with votes that overlap none of them)."""
    names = docs.columns
    patterns_ = BASE | {k: p for k, (p, _) in MORE.items()}
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = _made(df, **{f"_s_{k}": _steps(p, HINTS[k], F.col("_t")) for k, p in patterns_.items()})
    spans = {k: _spans(k, F.col(f"_s_{k}")) for k in patterns_}
    df = _made(df, _base=F.filter(F.concat(*[spans[k] for k in BASE]), _valid), _cand=F.concat(*[spans[k] for k in MORE]))
    df = _made(df, _in_base=F.when(F.size("_cand") > 0, _bounded(F.col("_base"))), _in_cand=_bounded(F.col("_cand")))
    # none overlaps a base span, nor a candidate of an earlier kind
    order = F.create_map(*[x for k, name in enumerate(MORE) for x in (F.lit(name), F.lit(k))])
    free = F.filter("_cand", lambda c: ~_meets(F.col("_in_base"), c) & ~_meets(F.col("_in_cand"), c, lambda b: order[b["kind"]] < order[c["kind"]]))
    return _made(df, _free=free).withColumn("_more", F.transform("_free", _votes)).select(*names, "_t", "_base", "_more")


def _votes(c: Column) -> Column:
    """A candidate with one bit for each labeler that votes; context is at most `BEFORE` characters after the last match of its kind."""
    kind, hit, before = c["kind"], c["hit"], c["before"]

    def by_kind(patterns: dict[str, str], on: Column) -> Column:
        out = F.lit(False)
        for k, p in patterns.items():
            out = F.when(kind == k, on.rlike(p)).otherwise(out)
        return out

    digits = _digits(hit)
    value = (F.when(kind == "national", ~digits.rlike(r"^[01]|^...[01]|^(.)\1+$"))
             .when(kind == "ssn", ~digits.rlike(r"^(?:000|666|9)|^...00|0000$"))
             .when(kind == "secret", hit.rlike(r"[0-9]") & hit.rlike(r"[A-Za-z]")).otherwise(hit.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}")))
    votes = [by_kind({k: s for k, (_, s) in MORE.items()}, hit), value, by_kind(KNOWN, hit), by_kind(CONTEXT, before), before.rlike(AGAINST)]
    bits = F.lit(0)
    for k, v in enumerate(votes):
        bits = bits + F.when(v, 1 << k).otherwise(0)
    return F.struct(kind.alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), bits.alias("votes"))


def patterns(rows: DataFrame) -> list[tuple[str, int, int]]:
    """(kind, votes, count) over all rows of `marked`: at most len(MORE) * 2 ** len(LABELERS) rows."""
    each = rows.select(F.explode("_more").alias("c"))
    return sorted((r["kind"], r["votes"], r["n"]) for r in each.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect())


def expected(rows: list[tuple[str, int, int]], rounds: int = 50) -> tuple[list[float], dict]:
    """Expectation-maximisation with a labeler's rates shared by all kinds and a prior for each kind.

    Returns the probability that each row's spans are personal data, and the rates.  The start says
    what labelers are made for: votes for (the first four) and against (the last one); a
    `PRIOR_VOTES` pseudo-votes at these rates keep them off 0 and 1.
    """
    m = len(LABELERS)
    start = [0.8, 0.8, 0.6, 0.7, 0.05], [0.3, 0.3, 0.2, 0.05, 0.5]
    yes, no = map(list, start)
    prior: dict[str, float] = {k: 0.5 for k, _, _ in rows}
    post = [0.5] * len(rows)
    for _ in range(rounds):
        for r, (kind, votes, _) in enumerate(rows):
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for k in range(m):
                v = votes >> k & 1
                a += math.log(yes[k] if v else 1 - yes[k])
                b += math.log(no[k] if v else 1 - no[k])
            post[r] = 1 / (1 + math.exp(min(50.0, max(-50.0, b - a))))
        total = sum(n for _, _, n in rows) or 1
        for k in range(m):
            hit = sum(p * n for p, (_, v, n) in zip(post, rows) if v >> k & 1)
            miss = sum((1 - p) * n for p, (_, v, n) in zip(post, rows) if v >> k & 1)
            n1 = sum(p * n for p, (_, _, n) in zip(post, rows))
            yes[k] = (hit + PRIOR_VOTES * start[0][k]) / (n1 + PRIOR_VOTES)
            no[k] = (miss + PRIOR_VOTES * start[1][k]) / (total - n1 + PRIOR_VOTES)
        for kind in prior:
            n = sum(c for k, _, c in rows if k == kind)
            prior[kind] = min(0.95, max(0.05, (sum(p * c for p, (k, _, c) in zip(post, rows) if k == kind) + 1) / (n + 2)))
    return post, {"yes": dict(zip(LABELERS, yes)), "no": dict(zip(LABELERS, no)), "prior": prior}


def train(rows: list[tuple[str, int, int]], rounds: int = 2000, rate: float = 0.5) -> dict[str, float]:
    """Logistic regression on votes and kind, with the expected labels as targets; weights by name."""
    post, _ = expected(rows)
    names = [*LABELERS, *MORE]
    w = dict.fromkeys([*names, "bias"], 0.0)
    w |= {"strict": 1.0, "value": 1.0, "context": 2.0, "against": -2.0, "bias": -1.0}
    total = sum(n for _, _, n in rows) or 1
    for _ in range(rounds if rows else 0):
        step = dict.fromkeys(w, 0.0)
        for p, (kind, votes, n) in zip(post, rows):
            on = [x for k, x in enumerate(LABELERS) if votes >> k & 1] + [kind, "bias"]
            miss = (p - 1 / (1 + math.exp(-sum(w[x] for x in on)))) * n / total
            for x in on:
                step[x] += miss
        for x in w:
            w[x] += rate * (step[x] - 1e-4 * w[x])
    return w


def _accepted(c: Column, w: dict[str, float]) -> Column:
    total = F.lit(w["bias"])
    for k, name in enumerate(LABELERS):
        total = total + F.when(c["votes"].bitwiseAND(1 << k) != 0, w[name]).otherwise(0.0)
    for kind in MORE:
        total = total + F.when(c["kind"] == kind, w[kind]).otherwise(0.0)
    return 1 / (1 + F.exp(-total)) >= ACCEPT


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _with_spans(df: DataFrame, w: dict[str, float]) -> DataFrame:
    """_spans: base and accepted spans, by kind as listed, then start."""
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    return df.withColumn("_spans", F.concat(F.transform("_base", bare), F.transform(F.filter("_more", lambda c: _accepted(c, w)), bare)))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def found(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    df = stash(marked(pick(docs, "doc_id", "text")).select("doc_id", "_base", "_more"))
    df = _with_spans(df, train(patterns(df)) if weights is None else weights)
    counts = [F.size(F.filter("_base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets; n_chars follows the new text if there is such a column.

    Overlapping spans (a card inside a phone number) are replaced from the first start to the last end, under the kind of the first.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = f"_c{names.index('text')}"
    df = stash(marked(flat, text).drop("_t")).withColumn("_t", F.coalesce(text, F.lit("")))
    df = _with_spans(df, train(patterns(df)) if weights is None else weights)
    df = _made(df, _line=F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("neg"), s["kind"].alias("kind")))))
    # after sorting by start, a span that begins before all earlier ones have ended joins them; each block of spans cuts its part out of the text once
    text_ = F.col("_t")

    def within(part: Column, acc: Column, block: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(block, start, lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            (-s["neg"]).alias("at"),
            F.concat(a["out"], F.substring(part, a["at"] - acc["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out")))
            .otherwise(F.struct(F.greatest(a["at"], -s["neg"]).alias("at"), a["out"].alias("out"))))

    def joined(acc: Column, block: Column) -> Column:
        part = F.substring(text_, acc["at"] + 1, F.greatest(-F.array_min(block["neg"]), acc["at"]) - acc["at"])
        once = F.transform(F.array(part), lambda p: within(p, acc, block))
        return F.transform(once, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    df = _made(df, _r=F.when(F.size("_line") > 0, F.aggregate(_blocks(F.col("_line")), none, joined)))
    new = F.when(F.col("_r").isNotNull(), F.concat(F.array_join("_r.out", ""), F.substring(text_, F.col("_r.at") + 1, F.length("_t")))).otherwise(F.col(text))
    out = df.withColumn("_new", new)
    cols = []
    for i, n in enumerate(names):
        c = F.col(f"_c{i}")
        if f"_c{i}" == text:
            c = F.col("_new")
        elif n == "n_chars":
            c = F.when(F.col("_r").isNotNull(), F.length("_new").cast(dict(flat.dtypes)[f"_c{i}"])).otherwise(c)
        cols.append(c.alias(f"_c{i}"))
    return out.select(*cols).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": query}
