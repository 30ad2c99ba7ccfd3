"""The text functions as SQL for the comparison engine; each takes and returns the text of an expression."""

from __future__ import annotations

from lakewarden.functions import text as T


def alnums(x: str) -> str:
    return f"length(regexp_replace({x}, '{T.OTHER}', '', 'g'))"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')"


def luhn(d: str) -> str:
    one = f"CAST(substr({d}, i, 1) AS INTEGER)"
    return f"(list_sum(list_transform(generate_series(1, length({d})), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN (2 * {one}) % 10 + (2 * {one}) // 10 ELSE {one} END)) % 10 = 0)"


def semantic_type(x: str) -> str:
    is_ = lambda p: f"regexp_matches({x}, '{p}')"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = '' THEN 'empty' WHEN {is_(T.EMAIL)} THEN 'email' WHEN {is_(T.URL)} THEN 'url' WHEN {is_(T.UUID)} THEN 'uuid' "
        f"WHEN {is_(T.IPV4)} OR ({is_(T.IPV6)} AND contains({x}, ':')) THEN 'ip_address' WHEN {is_(T.TIMESTAMP)} THEN 'timestamp' "
        f"WHEN CASE WHEN {is_(T.CARD)} AND length({digits(x)}) BETWEEN 13 AND 19 THEN {luhn(digits(x))} ELSE false END THEN 'credit_card' "
        f"WHEN {is_(T.NUMBER)} THEN 'number' WHEN {is_(T.PHONE)} THEN 'phone' WHEN lower({x}) IN ('true', 'false') THEN 'boolean' ELSE 'text' END"
    )


def shape(x: str, first: bool = False, last: bool = False) -> str:
    stars = f"regexp_replace({x}, '{T.LETTER_OR_DIGIT}', '*', 'g')"
    shown = stars
    if first or last:
        head = f"regexp_extract({x}, '(?s)^({T.OTHER}*{T.LETTER_OR_DIGIT})', 1)" if first else "''"
        tail = f"regexp_extract({x}, '(?s)({T.LETTER_OR_DIGIT}{T.OTHER}*)\\z', 1)" if last else "''"
        inner = f"substr({stars}, length({head}) + 1, length({x}) - length({head}) - length({tail}))"
        shown = f"CASE WHEN {alnums(x)} - {int(first) + int(last)} >= {T.LEAST_HIDDEN} THEN {head} || {inner} || {tail} ELSE {stars} END"
    return f"CASE WHEN {alnums(x)} = 0 THEN repeat('*', length({x})) ELSE {shown} END"


def prefix(x: str) -> str:
    return f"CASE WHEN regexp_matches(substr({x}, 1, 1), '{T.LETTER_OR_DIGIT}') AND {alnums(x)} - 1 >= {T.LEAST_HIDDEN} THEN substr({x}, 1, 1) ELSE '' END"


def mask_of_type(x: str, kind: str) -> str:
    local = f"split_part({x}, '@', 1)"
    domain = f"substr({x}, strpos({x}, '@') + 1)"
    name = f"regexp_extract({domain}, '(?s)^(.*)\\.[^.]*\\z', 1)"
    end = f"regexp_extract({domain}, '(?s)\\.([^.]*)\\z', 1)"
    email = f"({prefix(local)}) || '***@' || ({prefix(name)}) || '***.' || ({shape(end)})"
    card = f"rtrim(regexp_replace(repeat('*', length({digits(x)})), '(.{{4}})', '\\1-', 'g'), '-')"
    scheme = f"split_part({x}, '://', 1)"
    rest = f"substr({x}, strpos({x}, '://') + 3)"
    known = ", ".join(f"'{s}'" for s in T.KNOWN_SCHEMES)
    url = f"(CASE WHEN lower({scheme}) IN ({known}) THEN {scheme} ELSE {shape(scheme)} END) || '://' || ({shape(rest, first=True)})"
    return (
        f"CASE WHEN {kind} = 'empty' THEN '' WHEN {kind} = 'email' THEN {email} WHEN {kind} = 'credit_card' THEN {card} WHEN {kind} = 'url' THEN {url} WHEN {kind} = 'boolean' THEN '***' "
        f"WHEN {kind} IN ('uuid', 'ip_address', 'timestamp', 'phone') THEN {shape(x)} WHEN length({x}) > {T.COLLAPSE_ABOVE} THEN substr({x}, 1, 1) || '***' || right({x}, 1) ELSE {shape(x, True, True)} END"
    )


def masked(x: str, kind: str, first: str) -> str:
    need = f"least({alnums(x)}, greatest({T.LEAST_HIDDEN}, ({alnums(x)} + 1) // 2))"
    return f"CASE WHEN {alnums(x)} - {alnums(first)} >= {need} THEN {first} ELSE {shape(x)} END"


def mask_steps(source: str, x: str = "x") -> str:
    """CTE text: the rows of source (with a column x) and kind, masked and length."""
    return (
        f"typed AS (SELECT *, {semantic_type(x)} AS kind FROM ({source})), shaped AS (SELECT *, {mask_of_type(x, 'kind')} AS m0 FROM typed), "
        f"masks AS (SELECT *, CASE WHEN {x} IS NULL THEN NULL ELSE {masked(x, 'kind', 'm0')} END AS masked, CASE WHEN kind = 'boolean' THEN NULL ELSE CAST(length({x}) AS INTEGER) END AS length FROM shaped)"
    )


def ratio(part: str, whole: str, places: int = 6) -> str:
    scaled, whole = f"(CAST({part} AS HUGEINT) * {10**places})", f"CAST({whole} AS HUGEINT)"
    up = f"CASE WHEN 2 * ({scaled} % {whole}) > {whole} OR (2 * ({scaled} % {whole}) = {whole} AND ({scaled} // {whole}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {whole} = 0 THEN CAST(0 AS DECIMAL(20,{places})) ELSE CAST(CAST({scaled} // {whole} + {up} AS DECIMAL(20,0)) / {10**places} AS DECIMAL(20,{places})) END"
