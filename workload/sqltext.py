"""SQL forms of the text functions, for the DuckDB checks."""

from __future__ import annotations

import re

from orderlens import vocab

_SPACE = r"[\s\x{3000}]"


def quoted(words) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN ({quoted(vocab.BLANK)}))"


def name(x: str) -> str:
    return (f"COALESCE(regexp_replace(lower({x}), "
            r"'[\s\x{3000}_\-—/\\|（）()\[\]{}【】<>《》:：,.，。]+', '', 'g'), '')")


def number(x: str) -> str:
    cell = strip(x)
    unit = f"CASE WHEN contains({cell}, '亿') THEN 1e8 WHEN contains({cell}, '万') THEN 1e4 WHEN contains({cell}, '千') THEN 1e3 ELSE 1.0 END"
    value = f"(TRY_CAST(regexp_replace({cell}, '[^0-9.+\\-]', '', 'g') AS DOUBLE) * CAST({unit} AS DOUBLE))"
    return (f"CASE WHEN lower({cell}) IN ({quoted(vocab.BAD_NUMBER)}) THEN NULL "
            f"WHEN starts_with({cell}, '(') AND ends_with({cell}, ')') THEN -abs({value}) ELSE {value} END")


def lenient(x: str, default: str) -> str:
    return f"COALESCE(TRY_CAST(regexp_replace({x}, '[^0-9.\\-]', '', 'g') AS DOUBLE), {default})"


def normalised_status(n: str) -> str:
    """Standard status of an already normalised text."""
    def clean(word):
        return re.sub(r"[\s_\-]+", "", word.lower())

    exact, contained = [], []
    for status, words in vocab.STATUS_WORDS.items():
        tokens = sorted({clean(word) for word in words})
        exact.append(f"WHEN {n} IN ({quoted(tokens)}) THEN '{status}'")
        tests = " OR ".join(f"contains({n}, '{token}')" for token in tokens if len(token) >= 2)
        contained.append(f"WHEN {tests} THEN '{status}'")
    return f"CASE WHEN {n} = '' THEN 'unknown' {' '.join(exact + contained)} ELSE 'unknown' END"


def category(x: str) -> str:
    levels = f"list_transform(string_split_regex({x}, '[/＞>→|]'), lambda y: {strip('y')})"
    good = f"list_filter({levels}, lambda z: lower(z) NOT IN ({quoted(vocab.BLANK_CATEGORY)}))"
    return f"COALESCE({good}[1], '未分类')"


def timestamp(x: str, year: int) -> str:
    """Order date of a raw text, for the spellings that the raw export uses."""
    t = f"regexp_replace({strip(x)}, '\\.0$', '')"
    n = f"TRY_CAST({t} AS DOUBLE)"
    calendar = strip(f"replace(translate({t}, '年月/', '---'), '日', ' ')")
    yearless = f"regexp_full_match({calendar}, '\\d{{1,2}}-\\d{{1,2}}(\\s.*)?')"
    return (
        f"CASE WHEN regexp_full_match({t}, '\\d{{8}}') THEN try_strptime({t}, '%Y%m%d') "
        f"WHEN regexp_full_match({t}, '\\d{{5}}(\\.\\d+)?') AND {n} BETWEEN 20000 AND 80000 "
        f"THEN TIMESTAMP '1899-12-30' + to_microseconds(CAST(round({n} * 86400000000) AS BIGINT)) "
        f"WHEN regexp_full_match({t}, '\\d{{10}}') THEN make_timestamp(CAST({t} AS BIGINT) * 1000000) "
        f"WHEN regexp_full_match({t}, '\\d{{13}}') THEN make_timestamp(CAST({t} AS BIGINT) * 1000) "
        f"WHEN regexp_full_match({calendar}, '\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN try_strptime({calendar}, '%m-%d-%Y') "
        f"WHEN {yearless} THEN try_strptime('{year}-' || {calendar}, '%Y-%m-%d %H:%M') "
        f"ELSE TRY_CAST({calendar} AS TIMESTAMP) END"
    )


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
