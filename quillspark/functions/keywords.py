"""Keyword extraction for keyword search: stop words, CJK n-grams, Korean particles.

Stop words are a parameter; the default is STOP, the lists of seven languages together.
Other lists can be read from a text file of one word a line (``stop_words``).
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# English stop words.
STOP_EN = frozenset(
    """a an the this that these those i me my we our you your he she it they them is are was were be
    been being have has had do does did will would could should can may might in on at to for of with
    by from about into through during before after above below between under over and or but if then
    because as while when where what which who how why yesterday today tomorrow earlier later recently
    ago just now thing things stuff something anything everything nothing please help find show get
    tell give""".split()
)
# Spanish stop words.
STOP_ES = frozenset(
    """el la los las un una unos unas este esta ese esa yo me mi nosotros nosotras tu tus usted ustedes ellos
    ellas de del a en con por para sobre entre y o pero si porque como es son fue fueron ser estar haber tener
    hacer ayer hoy mañana antes despues después ahora recientemente que qué cómo cuando cuándo donde dónde
    porqué favor ayuda""".split()
)
# Portuguese stop words.
STOP_PT = frozenset(
    """o a os as um uma uns umas este esta esse essa eu me meu minha nos nós você vocês ele ela eles elas de do
    da em com por para sobre entre e ou mas se porque como é são foi foram ser estar ter fazer ontem hoje amanhã
    antes depois agora recentemente que quê quando onde porquê favor ajuda""".split()
)
# Arabic stop words (a phrase of two words can equal no token and has no place here).
STOP_AR = frozenset(
    """ال و أو لكن ثم بل أنا نحن هو هي هم هذا هذه ذلك تلك هنا هناك من إلى الى في على عن مع بين ل ب ك كان كانت
    يكون تكون صار أصبح يمكن ممكن بالأمس امس اليوم غدا الآن قبل بعد مؤخرا لماذا كيف ماذا متى أين هل فضلا
    ساعد""".split()
)
# Korean stop words.
STOP_KO = frozenset(
    """은 는 이 가 을 를 의 에 에서 로 으로 와 과 도 만 까지 부터 한테 에게 께 처럼 같이 보다 마다 밖에 대로
    나 나는 내가 나를 너 우리 저 저희 그 그녀 그들 이것 저것 그것 여기 저기 거기 있다 없다 하다 되다 이다 아니다
    보다 주다 오다 가다 것 거 등 수 때 곳 중 분 잘 더 또 매우 정말 아주 많이 너무 좀 그리고 하지만 그래서 그런데
    그러나 또는 그러면 왜 어떻게 뭐 언제 어디 누구 무엇 어떤 어제 오늘 내일 최근 지금 아까 나중 전에 제발
    부탁""".split()
)
# Japanese stop words.
STOP_JA = frozenset(
    """これ それ あれ この その あの ここ そこ あそこ する した して です ます いる ある なる できる の こと もの ため
    そして しかし また でも から まで より だけ なぜ どう 何 いつ どこ 誰 どれ 昨日 今日 明日 最近 今 さっき 前
    後""".split()
)
# Chinese stop words.
STOP_ZH = frozenset(
    """我 我们 你 你们 他 她 它 他们 这 那 这个 那个 这些 那些 的 了 着 过 得 地 吗 呢 吧 啊 呀 嘛 啦 是 有 在 被 把
    给 让 用 到 去 来 做 说 看 找 想 要 能 会 可以 和 与 或 但 但是 因为 所以 如果 虽然 而 也 都 就 还 又 再 才 只
    之前 以前 之后 以后 刚才 现在 昨天 今天 明天 最近 东西 事情 事 什么 哪个 哪些 怎么 为什么 多少 请 帮 帮忙
    告诉""".split()
)
#: The default: a word that any of the seven languages ignores.
STOP = STOP_EN | STOP_ES | STOP_PT | STOP_AR | STOP_KO | STOP_JA | STOP_ZH
# Korean particles, longest first.
PARTICLES = ("에서", "으로", "에게", "한테", "처럼", "같이", "보다", "까지", "부터", "마다", "밖에", "대로", "은", "는", "이", "가", "을", "를", "의", "에", "로", "와", "과", "도", "만")


def stop_words(spark: SparkSession, path: str) -> frozenset[str]:
    """A stop list of one word a line, in any language."""
    return frozenset(r.value.strip() for r in spark.read.text(path).collect() if r.value.strip())


@functools.cache
def _punctuation() -> str:
    marks = "".join(re.escape(chr(c)) for c in range(0x3100) if unicodedata.category(chr(c)).startswith("P"))
    return rf"[\s{marks}\uff00-\uff0f\uff1a-\uff20]+"


def _tokens(query: str, stop: frozenset[str]) -> list[str]:
    out = []
    for part in filter(None, re.split(_punctuation(), query.lower().strip())):
        if re.search("[\u3040-\u30ff]", part):
            for run in re.findall("[a-z0-9_]+|[\u30a0-\u30ffー]+|[\u4e00-\u9fff]+|[\u3040-\u309f]{2,}", part):
                out.append(run)
                if re.fullmatch("[\u4e00-\u9fff]+", run):
                    out += [run[i:i + 2] for i in range(len(run) - 1)]
        elif re.search("[\u4e00-\u9fff]", part):
            han = re.findall("[\u4e00-\u9fff]", part)
            out += han + [a + b for a, b in zip(han, han[1:], strict=False)]
        elif re.search("[\uac00-\ud7af\u3131-\u3163]", part):
            end = next((p for p in PARTICLES if len(part) > len(p) and part.endswith(p)), None)
            stem = part[: -len(end)] if end else None
            korean = bool(stem and re.search("[\uac00-\ud7af\u3131-\u3163]", stem))
            if part not in stop and not (korean and stem in stop):
                out.append(part)
            if stem and stem not in stop and (len(stem) >= 2 if re.search("[\uac00-\ud7af]", stem) else re.fullmatch("[a-z0-9_]+", stem)):
                out.append(stem)
        else:
            out.append(part)
    return out


def _valid(t: str) -> bool:
    if re.fullmatch("[a-zA-Z]+", t) and len(t) < 3:
        return False
    return not re.fullmatch(r"\d+", t) and not all(unicodedata.category(c)[0] in "PS" for c in t)


def extract(query: str, stop: frozenset[str] = STOP) -> list[str]:
    """Distinct keywords in order of appearance."""
    return list(dict.fromkeys(t for t in _tokens(query or "", stop) if t not in stop and _valid(t)))


def expand(query: str, stop: frozenset[str] = STOP) -> str:
    q = (query or "").strip()
    return " OR ".join([q, *extract(q, stop)])


def latin_keywords(query: Column, stop: frozenset[str] = STOP) -> Column:
    """The same for queries without CJK letters, as JVM expressions."""
    parts = F.split(F.lower(F.trim(query)), r"[\s\p{P}]+")
    good = lambda t: (F.length(t) > 0) & ~t.rlike(r"^[a-z]{1,2}$") & ~t.rlike(r"^\d+$") & ~t.rlike(r"^[\p{P}\p{S}]+$")
    kept = F.filter(parts, lambda t: good(t) & ~t.isin(*sorted(stop)))
    return F.array_distinct(kept)


def with_keywords(df: DataFrame, query: str = "query", stop: frozenset[str] = STOP) -> DataFrame:
    """Adds ``keywords`` and ``expanded`` (F47, F48); only rows with CJK letters leave the JVM."""
    @F.pandas_udf("array<string>")
    def cjk(s: pd.Series) -> pd.Series:
        return s.map(lambda q: extract(q, stop))

    wide = F.col(query).rlike(r"[\x{3040}-\x{30ff}\x{3131}-\x{3163}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]")
    out = df.withColumn("keywords", F.when(wide, cjk(F.when(wide, F.col(query)))).otherwise(latin_keywords(F.col(query), stop)))
    return out.withColumn("expanded", F.array_join(F.concat(F.array(F.trim(F.col(query))), F.col("keywords")), " OR "))


def augmented(text: Column) -> Column:
    """Text for a word index: Chinese and Japanese texts get their characters and pairs appended."""
    han = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0))
    pairs = F.zip_with(F.slice(han, 1, F.greatest(F.size(han) - 1, F.lit(0))), F.slice(han, 2, F.greatest(F.size(han) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(text.rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"), F.concat_ws(" ", text, F.array_join(han, " "), F.array_join(pairs, " "))).otherwise(text)
