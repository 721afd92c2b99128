"""Defects of question-answer pairs by labelling functions and a label model.

A helper reads each answer once: it takes JSON, fences and prose apart and tells plain facts. Labelling functions are
Columns over these facts; each votes for or against one defect or abstains. For each defect an expectation-maximisation
model learns from the vote patterns of all pairs how far each function is to be trusted, without any labels: Spark
counts the patterns (at most 3^k for k functions, whatever the collection), the model is fitted to these counts. On one
half of the pairs the model is fitted, on the other the cutoff is chosen that gives the best expected F1. A pair keeps
every label whose posterior reaches its cutoff; where one defect a pair is asked for, the order of DEFECTS decides.

Defined results: a null answer is empty; with a null or blank question nothing is copied and no language is expected;
pairs sent twice count once; an empty table gives an empty result; answers of any length are read whole.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

DEFECTS = ["empty", "refusal", "copied_question", "truncated", "other_language"]

# Words that tell languages, names of languages in requests, marks of refusal, words that cannot end SQL.
STOPWORDS = {
    "en": "the is are by to of and in for not so no from with that this was were only here list show what over first last per each highest".split(),
    "de": "der die das und ist nicht ein eine den dem von je im werden wird auf nach bitte wie zeige sich aus mit zu gehören".split(),
    "es": "el la los las de del por en que es un una para con se no cuál fue muestra compara según lo y al".split(),
    "fr": "le la les des du par est un une et dans pour que ne pas sont aux ce sur au avec".split(),
    "pt": "o os as do da dos das por em que não é um uma para com se no na ao".split(),
    "it": "il lo gli della del di per che è un una non con sono nel alla dei le".split(),
}
LANGUAGE_NAMES = {
    "en": "英文|英语|english|englisch|inglés|ingles|anglais|英語",
    "zh": "中文|汉语|chinese|chinesisch|chino|chinois",
    "de": "德文|德语|german|deutsch|alemán|aleman|allemand",
    "es": "西班牙文|西班牙语|spanish|spanisch|español|espagnol",
    "fr": "法文|法语|french|französisch|francés|français",
    "ja": "日文|日语|japanese|japanisch|japonés|japonais",
}
REFUSAL = (
    r"(?i)i can.?t help|can.?not help|unable to help|i must decline|must decline|falls outside what i|not allowed to|no answer can be given|i.m sorry, but|i am sorry, but|"
    r"won.?t be able|cannot provide|can.?t provide|cannot answer|not permitted|as an ai|as a language model|"
    r"恕不能|恕难|不能协助|无法协助|帮不上忙|我没有权限|不便提供|不予生成|谢绝|不能提供该|无法提供|超出了我的能力|作为语言模型|拒绝|"
    r"guidelines prevent|rather not generate|won.?t write|无法回答|不能回答|nicht gestattet|queda fuera de lo|disculpe|"
    r"kann ich nicht|darf ich nicht|nicht beantworten|nicht weiterhelfen|ablehnen|als ki|als sprachmodell|nicht helfen|keine auskunft|leider|"
    r"no puedo ayudar|debo rechazar|no puedo responder|no me está permitido|no estoy autorizad|lo siento|como modelo de lenguaje|como ia|no puedo"
)
DANGLING = "select from where and or by group order on as between in join left right inner outer full is not having with distinct like union all limit case when then else using asc_ null_".split()

FENCE = re.compile(r"```[ \t]*\w*[ \t]*\n?")
PLACEHOLDER = re.compile(r"^(?:n/?a|null|none|nil|nan|empty|tbd|todo|undefined|无|空|-+|\.+)?$", re.IGNORECASE)
LEAD = re.compile(r"^\s*[>\"'「“]*\s*(?:question|frage|pregunta|问题|问|q)\s*[:：]\s*", re.IGNORECASE)
KANA, HAN = re.compile(r"[぀-ヿ]"), re.compile(r"[㐀-鿿]")
AGGREGATE = re.compile(r"\b(?:sum|avg|min|max|count)\s*\(", re.IGNORECASE)


def _strip_strings(sql: str) -> tuple[str, bool]:
    """SQL without comments, texts and quoted names; whether a quote stays open."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL)
    bare = re.sub(r"'(?:[^']|'')*'", " 0 ", bare)
    bare = re.sub(r'"[^"]*"', " q ", bare)
    return bare.replace("_x000D_", " "), "'" in bare or '"' in bare


def _top_level(text: str) -> list[str]:
    """Items of a list that stand outside parentheses; what is inside is left out."""
    n = 1
    while n:
        text, n = re.subn(r"\([^()]*\)", "\x00", text)
    return [x.replace("\x00", "()").strip() for x in text.split(",")]


def _last_name(item: str) -> str:
    return re.split(r"[.\s]", item.strip().lower())[-1]


def _ungrouped(select: str, rest: str) -> bool:
    """Whether a select list mixes aggregates with columns by which the rest does not group: a GROUP BY that was cut."""
    items = [x for x in _top_level(re.sub(r"^\s*distinct\b", "", select, flags=re.IGNORECASE)) if x]
    summed = [x for x in items if AGGREGATE.search(x) and not re.search(r"\bover\b", x, re.IGNORECASE)]
    plain = [x for x in items if re.fullmatch(r"[\w.]+(?:\s+(?:as\s+)?\w+)?", x, re.IGNORECASE) and not re.fullmatch(r"[\d.]+|true|false|null", x.split()[0], re.IGNORECASE)]
    if not summed or not plain:
        return False
    grouped = re.search(r"\bgroup\s+by\b(.*?)(?:\bhaving\b|\border\s+by\b|\blimit\b|\bqualify\b|\bunion\b|$)", rest, re.IGNORECASE | re.DOTALL)
    if grouped is None:
        return True
    body = grouped.group(1)
    if re.search(r"\b(?:all|rollup|cube|grouping\s+sets)\b", body, re.IGNORECASE):
        return False
    keys = {_last_name(k) for k in _top_level(body) if k}
    return any(str(items.index(x) + 1) not in keys and _last_name(x.split()[0]) not in keys and _last_name(x) not in keys for x in plain)


def sql_is_cut(sql: str) -> bool:
    """Whether a statement stops before its end, as far as its form tells: an open quote or bracket, a clause or operator
    without its operand, no source for its columns, columns left ungrouped beside aggregates."""
    bare, quote = _strip_strings(sql)
    bare = bare.strip().rstrip(";").strip()
    if quote or bare.count("(") != bare.count(")"):
        return True
    if re.search(r"[,(=<>+\-/|.]$", bare):
        return True
    words = re.findall(r"[\w.*?]+|[^\s\w]", bare.lower())
    if not words or words[-1] in DANGLING:
        return True
    if "from" not in words:  # complete only without columns
        return words[0] != "select" or len(words) < 2 or any(re.fullmatch(r"[a-z_][\w.]*", w) and w not in ("as", "true", "false", "null") and after != "(" and before != "as" for before, w, after in zip(words, words[1:], [*words[2:], ""], strict=False))
    tail = re.search(r"\b(?:and|or|where|having|on|not)\s+([\w.]+)$", bare, re.IGNORECASE)
    if tail and not re.search(r"\bbetween\s+\S+\s+and\s+\S+$|\bis\s+not\s+\w+$", bare, re.IGNORECASE) and not re.fullmatch(r"(?:is|has|can|was)_\w+|\w+_flag|flag|true|false|active|enabled|deleted|valid", _last_name(tail.group(1))):
        return True  # a column alone is no condition, unless it is named like a truth value
    if re.search(r"\b(?:is|is\s+not|between)\s+\w*$", bare, re.IGNORECASE) and not re.search(r"\bis\s+(?:not\s+)?(?:null|true|false|unknown)$", bare, re.IGNORECASE):
        return True
    if words[0] == "with" and not re.search(r"\)\s*select\b.+\bfrom\s+\S+", bare, re.IGNORECASE | re.DOTALL):
        return True
    inner = re.search(r"^\s*with\s+\w+\s+as\s*\((.*)\)\s*select\b", bare, re.IGNORECASE | re.DOTALL)
    shape = re.search(r"^\s*select\b(.*?)\bfrom\b(.*)$", inner.group(1) if inner else bare, re.IGNORECASE | re.DOTALL)
    if shape and _ungrouped(*shape.groups()):
        return True
    grouped = re.search(r"\bgroup\s+by\b(.*?)(?:\border\s+by\b|\blimit\b|\bhaving\b|$)", bare, re.IGNORECASE | re.DOTALL)
    if grouped and not inner and any(re.search(r"[\w)]\s+(?!with\s+rollup)\w+$", g) for g in _top_level(grouped.group(1))):
        return True  # two names side by side: the next clause has only begun
    tail = re.search(r"\border\s+by\s+[\w.]+\s+(\w+)(?:\s+(\w+))?$", bare, re.IGNORECASE)
    return bool(tail and (tail.group(1).lower() not in ("asc", "desc", "limit", "nulls") or tail.group(2) and not tail.group(2).isdigit() and tail.group(2).lower() not in ("first", "last")))


def _texts(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in _texts(v)]
    if isinstance(value, dict):
        return [t for v in value.values() for t in _texts(v)]
    return []


def _is_sql(text: str) -> bool:
    return bool(re.match(r"\s*(?:--[^\n]*\n\s*)*(?:select|with)\b", text, re.IGNORECASE))


def read_answer(response: str | None) -> dict:
    """json: 1 whole, 0 broken, None none. fence: 1 closed, 0 open, None none. sql, prose: the texts found. loose_end: prose outside JSON stops without a mark."""
    text = (response or "").strip()
    fences = text.count("```")
    out: dict = {"json": None, "fence": None if not fences else int(fences % 2 == 0), "sql": "", "prose": "", "loose_end": None}
    prose, sql = [], []
    rest = text
    start = re.search(r"(?:^|[\n`:：])\s*(?:```\w*\s*)?([{\[])", text)
    if start:
        at = start.start(1)
        try:
            value, end = json.JSONDecoder().raw_decode(text, at)
            out["json"] = 1
            body = value if isinstance(value, dict) else {"assumptions": value}
            for k, v in body.items():
                if k in ("tables", "columns"):
                    continue
                for t in _texts(v):
                    (sql if k == "sql" and _is_sql(t) else prose).append(t)
            rest = text[:at] + " " + text[end:]
        except ValueError:
            out["json"] = 0
            found = re.search(r'"sql"\s*:\s*"((?:[^"\\]|\\.)*)', text)
            if found:
                sql.append(found.group(1))
            prose += re.findall(r'"((?:[^"\\]|\\.){25,})"', text[:at] + (text[at : found.start()] if found else text[at:]))
            rest = text[:at]
    if out["json"] is None:
        parts = FENCE.split(rest)
        plain = []
        for i, p in enumerate(parts):
            if _is_sql(p):
                sql.append(p)
            elif i % 2 and len(parts) > 2:
                prose.append(p)
            else:
                plain.append(p)
        tail = plain[-1].strip() if plain else ""
        if tail and (not parts or not _is_sql(parts[-1])):
            out["loose_end"] = int(not re.search(r"[.。!?！？…:：」\"')]\s*\W*$", tail))
        prose += plain
    else:
        prose.append(FENCE.sub(" ", rest))
    out["sql"], out["prose"] = "\n".join(s for s in sql if s.strip()), "\n".join(p.strip() for p in prose if p and p.strip())
    return out


def language(text: str) -> str | None:
    """Language of some prose by script and stop words; None if it can't be told."""
    text = re.sub(r"[A-Za-z0-9_.]*[_\d][A-Za-z0-9_.]*", " ", text)
    if KANA.search(text):
        return "ja"
    if len(HAN.findall(text)) >= 0.3 * max(1, sum(map(str.isalpha, text))):
        return "zh"
    score = dict.fromkeys(STOPWORDS, 0)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for k in _LANGUAGES.get(word, ()):
            score[k] += 1
    best = max(score, key=score.get)
    second = max(v for k, v in score.items() if k != best)
    return best if score[best] > second and (score[best] >= 2 or not second) else None


_LANGUAGES: dict[str, list[str]] = {}
for _k, _words in STOPWORDS.items():
    for _w in set(_words):
        _LANGUAGES.setdefault(_w, []).append(_k)
_ASKED = re.compile("|".join(rf"(?P<{k}>(?:用|以|\bin|\bauf|\ben|で)\s*(?:{names}))" for k, names in LANGUAGE_NAMES.items()), re.IGNORECASE)


def expected_language(question: str) -> str | None:
    asked = _ASKED.search(question)
    if asked:
        return asked.lastgroup
    return language(question)


def _grams(text: str) -> set[str]:
    text = "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())
    n = 2 if HAN.search(text) else 3
    return {text[i : i + n] for i in range(max(len(text) - n + 1, 1))} if text else set()


def copy_shares(question: str, said: str) -> tuple[float, float]:
    """Shares of what was said that the question has, and of the question that was said again (by character runs)."""
    q, s = _grams(question), _grams(LEAD.sub("", said))
    return (len(q & s) / len(s), len(q & s) / len(q)) if q and s else (0.0, 0.0)


FACTS = "json int, fence int, loose_end int, has_sql int, sql_cut int, said int, letters int, prose string, copied double, repeated double, asked string, told string"


def answer_facts(df: DataFrame, key: str, question: str, response: str) -> DataFrame:
    """(key, FACTS) of each distinct pair."""
    names = ["key", *(c.split()[0] for c in FACTS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, q, r in batch.itertuples(index=False, name=None):
                q, a = q or "", read_answer(r)
                sql, prose = a["sql"], a["prose"]
                said = bool(sql) or not PLACEHOLDER.match(re.sub(r"[\s\"'`{}\[\]()]+", "", prose))
                shares = copy_shares(q, prose) if prose and not sql else (0.0, 0.0)
                own = prose.replace(q.strip(), " ") if q.strip() else prose
                rows.append((k, a["json"], a["fence"], a["loose_end"], int(bool(sql)), int(sql_is_cut(sql)) if sql else None, int(said), sum(map(str.isalnum, prose)), own if not sql else "", *shares, expected_language(q) if q.strip() else None, language(own)))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("json", "fence", "loose_end", "sql_cut")})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(question).cast("string").alias("question"), F.col(response).cast("string").alias("response"))
    return rows.mapInPandas(run, f"key {kind}, {FACTS}")


def labelling_functions() -> dict[str, list[Column]]:
    """Per defect its functions: 1 for, 0 against, null abstains."""
    c = F.col
    yes = lambda test: F.when(test, 1).otherwise(0)
    when = lambda on, test: F.when(on, yes(test))
    no_sql, said = c("has_sql") == 0, c("said") == 1
    refuses = c("prose").rlike(REFUSAL)
    whole = (F.coalesce("json", F.lit(1)) == 1) & (F.coalesce("fence", F.lit(1)) == 1) & (F.coalesce("loose_end", F.lit(0)) == 0)
    return {
        "empty": [yes(~said), yes(no_sql & ((c("letters") < 4) | F.lower(F.trim("prose")).isin("null", "none", "empty", "n/a"))), F.when(c("has_sql") == 1, 0)],
        "refusal": [F.when(said & no_sql & refuses, 1), when(no_sql & said, (c("copied") < 0.75) & whole | refuses), F.when(c("has_sql") == 1, 0)],
        "copied_question": [yes(said & no_sql & (c("copied") >= 0.75) & (c("repeated") >= 0.4)), when(no_sql & said & ~refuses, c("copied") >= 0.7), F.when(refuses | (c("has_sql") == 1), 0)],
        "truncated": [F.when(c("json") == 0, 1), F.when(c("fence") == 0, 1), F.when(c("sql_cut") == 1, 1), F.when((c("loose_end") == 1) & said & ((c("has_sql") == 1) | (c("copied") < 0.7) & ~refuses), 1), F.when(whole & (F.coalesce("sql_cut", F.lit(0)) == 0), 0)],
        "other_language": [F.when(c("asked").isNotNull() & c("told").isNotNull() & (c("has_sql") == 1), (c("asked") != c("told")).cast("int")), F.when(no_sql, 0)],
    }


class LabelModel:
    """Votes with a hidden label, fitted by expectation maximisation to pattern counts.

    A vote weighs the ratio of how often it is cast on pairs with and without the label, as the pairs tell; an abstention
    weighs nothing, since a function that sees one form of a defect says nothing of the others. A pair for which no function
    votes does not bear the label, so functions that only ever vote for it do not raise its share. The only bounds: no
    vote tells against its own direction, else the labels could change places. ``share`` and ``first`` (weights of votes
    for and against) are where the rounds begin; ``few`` pairs' worth of them stays in.
    """

    def __init__(self, share: float = 0.02, first: tuple[float, float] = (300.0, 0.05), few: float = 2.0, rounds: int = 200):
        self.share, self.first, self.few, self.rounds = share, first, few, rounds

    def fit(self, votes: np.ndarray, n: np.ndarray) -> LabelModel:
        """votes: a row per pattern with 1, 0 or NaN. n: how many pairs have it."""
        k = votes.shape[1]
        self.yes, self.no, self.prior = np.full(k, self.first[0]), np.full(k, self.first[1]), self.share
        ones, zeros = votes == 1, votes == 0
        for _ in range(self.rounds):
            y = self.posterior(votes)
            with_, without = n * y, n * (1 - y)
            rate = lambda w, cast, own: ((w[:, None] * cast).sum(0) + self.few * own) / (w.sum() + self.few)
            self.yes = np.maximum(rate(with_, ones, 1.0) / rate(without, ones, 1 / self.first[0]), 1.0)
            self.no = np.minimum(rate(with_, zeros, self.first[1]) / rate(without, zeros, 1.0), 1.0)
            self.prior = float(np.clip(with_.sum() / max(n.sum(), 1.0), 1e-6, 0.5))
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        weight = np.where(votes == 1, np.log(self.yes), np.where(votes == 0, np.log(self.no), 0.0)).sum(1)
        y = 1 / (1 + np.exp(-np.clip(weight + np.log(self.prior / (1 - self.prior)), -60, 60)))
        return np.where((votes == 1).any(1), y, 0.0)


def best_cutoff(y: np.ndarray, n: np.ndarray) -> float:
    """The cutoff with the best expected F1 on pairs with posteriors ``y``, midway to the next lower posterior; 0.5 where there is nothing to tell."""
    best, at = 0.0, 0.5
    levels = np.unique(y)
    for i, cut in enumerate(levels):
        if cut < 0.3:
            continue
        taken = y >= cut
        f1 = 2 * (n * y)[taken].sum() / (n[taken].sum() + (n * y).sum())
        if f1 > best + 1e-12:
            best, at = f1, float(cut + (levels[i - 1] if i else 0.0)) / 2
    return at


def defect_posteriors(facts: DataFrame) -> DataFrame:
    """(key, defect, posterior, cutoff) of every pair and defect whose posterior reaches its cutoff."""
    functions = labelling_functions()
    cols = {f"{d}_{i}": f.cast("int") for d, fs in functions.items() for i, f in enumerate(fs)}
    votes = materialise(facts.select("key", *[c.alias(n) for n, c in cols.items()]).distinct(), "votes")
    half = F.pmod(F.xxhash64("key"), F.lit(2)).alias("half")
    out = None
    for defect, fs in functions.items():
        names = [f"{defect}_{i}" for i in range(len(fs))]
        counts = votes.groupBy(half, *names).count().toPandas()  # at most 2 * 3^len(fs) rows
        own = counts.groupby("half")
        fit = own.get_group(0) if 0 in own.groups else counts
        held = own.get_group(1) if 1 in own.groups else counts
        model = LabelModel().fit(fit[names].to_numpy(float), fit["count"].to_numpy(float))
        cut = best_cutoff(model.posterior(held[names].to_numpy(float)), held["count"].to_numpy(float))
        grid = list(itertools.product((None, 0, 1), repeat=len(names)))
        post = model.posterior(np.array(grid, dtype=float))
        same = [F.concat_ws("", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])]
        table = F.create_map(*[x for g, p in zip(grid, post, strict=True) for x in (F.lit("".join("-" if v is None else str(v) for v in g)), F.lit(float(p)))])
        rows = votes.select("key", F.lit(defect).alias("defect"), F.try_element_at(table, same[0]).alias("posterior"), F.lit(max(cut, 0.3)).alias("cutoff"))
        rows = rows.filter("posterior >= cutoff - 1e-9")
        out = rows if out is None else out.unionByName(rows)
    return out


def one_defect(posteriors: DataFrame) -> DataFrame:
    """(key, defect): of each pair the first of its defects in the order of DEFECTS."""
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    first = posteriors.groupBy("key").agg(F.min(rank).alias("rank"))
    return first.select("key", F.element_at(F.array(*[F.lit(d) for d in DEFECTS]), F.col("rank").cast("int")).alias("defect"))
