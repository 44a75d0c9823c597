"""DuckDB twins of the registered queries.

Only the relations they start from are shared with the engine. Rules, limits and word lists are stated here once more, so that a wrong
one on either side shows.
"""

from __future__ import annotations

from pagewright.sources import derive as R

# Markers of registration documents.
CRITICAL = ["सूची क्र.2", "सूची क्र.२", "index-ii", "index ii", "regn:63m", "regn.63m", "regn:63", "दुय्यम निबंधक", "गावाचे नाव", "विलेखाचा प्रकार", "बाजारभाव"]
DEFINITIVE = ["सूची क्र.2", "सूची क्र.२", "index-ii", "index ii", "regn:63m", "regn.63m", "दुय्यम निबंधक"]
STRONG = ["sub-registrar class", "joint sub-registrar", "मोबदला", "भू-मापन", "पालिकेचे नाव", "हवेली"]
SUPPORTING = ["stamp duty", "registration fee", "echallan"]
HEADER = ["सूची क्र.2", "सूची क्र.२", "index-ii", "index ii", "index-2", "regn:63m", "regn.63m", "regn 63m", "regn:63", "दुय्यम निबंधक", "गावाचे नाव", "विलेखाचा प्रकार", "बाजारभाव", "सब रजिस्ट्रार", "उप निबंधक"]
NEGATIVE = (
    "no objection certificate;no objection;noc;no dues certificate;no dues;clearance certificate;non encumbrance;bonafide certificate;society;co-op;co-operative;cooperative;"
    "housing society;to whomsoever;to whom;this is to certify;property tax;tax receipt;deed of assignment;assignment;deed of transfer;agreement;sale agreement;"
    "purchase agreement;agreement to sell;will;testament;testator;executor;bequeath;bequeathed;vendor;purchaser;assignor;assignee;transferor;transferee;power of attorney;poa"
).split(";")
STRONG_NEGATIVE = (
    "no objection certificate;no objection;noc;no dues certificate;no dues;clearance certificate;society;deed of assignment;assignment;agreement;sale agreement;purchase agreement;"
    "agreement to sell;will;testament;testator;bequeath;bequeathed;vendor;purchaser;assignor;assignee;transferor;transferee;power of attorney;poa"
).split(";")
PRINTED_KEYWORDS = ["payment", "details", "registry", "index", "सूची", "मोबदला", "regn"]

# Words of captions.
PRINTED_STRONG = ["printed", "typed", "computer-generated", "digital", "system-generated", "form", "official document", "certificate", "template", "scanned document"]
PRINTED_WEAK = ["document", "pdf", "text", "stamp", "seal"]
HANDWRITTEN_STRONG = ["handwritten", "handwriting", "written by hand", "manuscript", "cursive", "script", "hand-drawn", "written manually", "hand written"]
HANDWRITTEN_WEAK = ["pen", "pencil", "ink", "written"]
SIGNATURE = ["signature", "signed", "stamp", "seal"]
PRINTED_TEXT = ["text", "printed", "typed", "form", "document"]

PM = f"pm AS ({R.PAGE_METRICS})"


def r2(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


def kind(name: str, critical: str | None, warning: str) -> str:
    first = f"WHEN {critical} THEN 'critical' " if critical else ""
    return f"CASE {first}WHEN {warning} THEN 'warning' ELSE 'pass' END AS k_{name}"


KINDS = [
    kind("resolution", "width < 400 OR height < 300", "width < 800 OR height < 600"),
    kind("blur", "blur < 30", "blur < 60"),
    kind("brightness", "brightness < 15 OR brightness > 300", "brightness < 35 OR brightness > 220"),
    kind("contrast", "contrast < 15", "contrast < 22"),
    kind("white_space", None, "white_space >= 80"),
    kind("skew", None, "abs(skew) >= 15"),
    kind("corruption", "thick > 25 OR (irregularity > 100 AND thick > 15)", "thick > 18 OR irregularity > 80"),
]
NAMES = ["resolution", "blur", "brightness", "contrast", "white_space", "skew", "corruption"]


def entries(kind_: str) -> str:
    inner = ", ".join(f"CASE WHEN k_{n} = '{kind_}' THEN '{n}' END" for n in NAMES)
    return f"list_filter([{inner}], lambda x: x IS NOT NULL)"


POINTS = " + ".join(f"(CASE k_{n} WHEN 'pass' THEN 100 WHEN 'warning' THEN 50 ELSE 0 END)" for n in NAMES)
S1 = f"""
s1 AS (SELECT *, {r2(f'CAST({POINTS} AS DOUBLE) / 7')} AS s1_score, {entries('critical')} AS c1, {entries('warning')} AS w1
  FROM (SELECT *, {', '.join(KINDS)} FROM pm))"""
S2 = f"""
s2 AS (SELECT *,
    CASE WHEN ocr < 25 THEN CAST(0 AS DOUBLE) ELSE {r2("least(ocr / 100, CAST(1 AS DOUBLE)) * 40 + CAST((ocr >= 45)::INT + (hi_words >= 5)::INT + (regions >= 2)::INT + (chars >= 30)::INT AS DOUBLE) / 4 * 60")} END AS s2_score,
    CASE WHEN ocr < 25 THEN ['ocr_unreadable'] ELSE CAST([] AS VARCHAR[]) END AS c2,
    CASE WHEN ocr < 25 THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN ocr < 45 THEN 'ocr_confidence' END, CASE WHEN hi_words < 5 THEN 'high_confidence_words' END,
      CASE WHEN regions < 2 THEN 'text_regions' END, CASE WHEN chars < 30 THEN 'characters' END], lambda x: x IS NOT NULL) END AS w2
  FROM s1)"""
D_ = lambda x: f"CAST({x} AS DOUBLE)"
S3 = f"""
s3a AS (SELECT *, hot_regions * 100 < 25 * 16 AS conc, hot_regions * 100 > 50 * 16 AS spread FROM s2),
s3b AS (SELECT *, CASE WHEN hw >= 40 THEN 1 WHEN spread AND hw >= 25 THEN 2 WHEN conc AND hw < 30 THEN 3 WHEN hw >= 20 AND hw < 30 THEN 4 WHEN hw >= 10 THEN 5 ELSE 6 END AS s3_branch FROM s3a),
s3 AS (SELECT *,
    CASE WHEN s3_branch <= 2 THEN {D_(0)} WHEN s3_branch = 3 THEN greatest({D_(80)}, 100 - hw * {D_(0.5)}) WHEN s3_branch = 4 THEN greatest({D_(60)}, 100 - hw * {D_(1.5)})
      WHEN s3_branch = 5 THEN greatest({D_(85)}, 100 - hw * {D_(1.5)}) ELSE {D_(100)} END AS s3_score,
    CASE WHEN s3_branch <= 2 THEN 'REJECT' WHEN s3_branch = 4 THEN 'WARNING' ELSE 'ACCEPT' END AS s3_action,
    CASE s3_branch WHEN 1 THEN ['handwritten'] WHEN 2 THEN ['handwriting_spread'] ELSE CAST([] AS VARCHAR[]) END AS c3,
    CASE WHEN s3_branch = 3 AND hw >= 15 THEN ['signatures'] WHEN s3_branch IN (3, 5) THEN ['minor'] WHEN s3_branch = 4 THEN ['moderate'] ELSE CAST([] AS VARCHAR[]) END AS w3
  FROM s3b)"""
S4 = f"""
s4 AS (SELECT *, greatest({D_(0)}, 100 - brisque) AS s4_score,
    CASE WHEN brisque >= 55 THEN 'Poor' WHEN brisque >= 50 THEN 'Acceptable' WHEN brisque >= 30 THEN 'Good' ELSE 'Excellent' END AS quality_level,
    CASE WHEN brisque >= 55 THEN ['quality_poor'] WHEN brisque >= 50 THEN ['quality_acceptable'] ELSE CAST([] AS VARCHAR[]) END AS w4
  FROM s3),
fin AS (SELECT *, {r2(f's1_score * {D_(0.35)} + s2_score * {D_(0.40)} + s3_score * {D_(0.20)} + s4_score * {D_(0.05)}')} AS final_score,
    c1 || c2 || c3 AS crit, w1 || w2 || w3 || w4 AS warn FROM s4)"""
STAGED = ",".join([PM, S1, S2, S3, S4])

FILTER = """
flags AS (SELECT *, list_contains(c1, 'blur') AND (ocr >= 80 OR (ocr >= 50 AND blur >= 15)) AS no_blur,
    ocr >= 50 AND blur >= 15 AND blur < 30 AND list_contains(c3, 'handwriting_spread') AS no_hand FROM fin),
filt AS (SELECT * EXCLUDE (c1, c3, crit, warn),
    list_filter(c1, lambda x: NOT (no_blur AND x = 'blur')) AS c1,
    list_filter(c3, lambda x: NOT (no_hand AND x = 'handwriting_spread')) AS c3,
    list_filter(crit, lambda x: NOT (no_blur AND x = 'blur') AND NOT (no_hand AND x = 'handwriting_spread')) AS crit,
    warn || list_filter([CASE WHEN no_blur AND ocr >= 80 THEN 'blur_readable' WHEN no_blur THEN 'blur_slight' END, CASE WHEN no_hand THEN 'handwriting_unreliable' END], lambda x: x IS NOT NULL) AS warn
  FROM flags)"""


#: The consensus rules as nested decisions: first readable text against handwriting and the caption model, then what makes a page useless.
CONSENSUS = """
CASE
  WHEN ocr >= 80 AND hw >= 40 AND NOT f THEN CASE WHEN ocr >= 85 THEN 'C1' ELSE 'C2' END
  WHEN ocr >= 80 AND hw >= 40 AND f THEN 'C3'
  WHEN ocr >= 85 AND hw >= 40 AND hw < 50 THEN 'C4'
  WHEN ocr >= 80 AND hw >= 50 THEN 'C5'
  WHEN ocr < 20 THEN 'C6'
  WHEN h >= 40 THEN CASE WHEN ocr < 70 THEN 'C12' WHEN NOT f AND ocr >= 85 THEN 'C7' WHEN NOT f THEN 'C8' WHEN f THEN 'C9' WHEN ocr >= 75 THEN 'C10' ELSE 'C11' END
  WHEN h >= 30 AND ocr >= 60 AND f THEN 'C13'
  WHEN h >= 25 AND spread THEN CASE WHEN ocr < 60 THEN 'C16' WHEN f THEN 'C14' ELSE 'C15' END
  WHEN width < 400 OR height < 300 THEN 'C17'
  WHEN blur < 15 AND ocr < 50 THEN 'C18'
  WHEN blur < 30 AND ocr < 50 THEN CASE WHEN ocr >= 30 THEN 'C19' ELSE 'C20' END
  WHEN n_all > 0 THEN CASE WHEN ocr >= 50 AND (blur >= 15 OR ocr >= 80) AND n_other = 0 THEN 'C21a' ELSE 'C21b' END
  WHEN ocr > 80 AND h < 15 AND blur > 100 AND width > 800 THEN 'C22'
  WHEN h > 15 AND h < 30 AND conc THEN CASE WHEN ocr >= 30 THEN 'C23a' ELSE 'C23b' END
  WHEN ocr > 75 AND h > 25 AND h < 40 THEN CASE WHEN conc THEN 'C24a' WHEN spread THEN 'C24b' ELSE 'C24c' END
  WHEN ocr < 50 AND blur > 150 AND width > 1000 THEN 'C25'
  WHEN h > 20 AND ocr > 70 THEN CASE WHEN blur < 60 THEN 'C26a' WHEN conc THEN 'C26b' WHEN spread THEN 'C26c' ELSE 'C26d' END
  ELSE 'C27' END"""
SCORED = """
CASE WHEN has_critical THEN 'D1'
  WHEN ocr >= 80 AND final_score >= 55 THEN CASE WHEN final_score >= 75 THEN 'D2h' ELSE 'D2n' END
  WHEN ocr >= 60 AND ocr < 80 AND final_score >= 60 THEN CASE WHEN final_score >= 85 THEN 'D3h' ELSE 'D3n' END
  WHEN final_score >= 60 THEN CASE WHEN final_score >= 85 THEN 'D4h' ELSE 'D4n' END
  WHEN final_score >= 50 THEN 'D5' ELSE 'D6' END"""
STATUS = """
CASE WHEN rule_id IN ('C1', 'C3', 'C4', 'C7', 'C9', 'C10', 'C13', 'C14', 'C22', 'C23a', 'C24a', 'C26a', 'C26b', 'C26d', 'D2h', 'D2n', 'D3h', 'D3n', 'D4h', 'D4n') THEN 'ACCEPTED'
  WHEN rule_id IN ('C19', 'C23b', 'C24b', 'C24c', 'C25', 'D5') THEN 'FLAG_FOR_REVIEW' ELSE 'REJECTED' END"""
PRIORITY = """
CASE WHEN rule_id IN ('C22', 'D2h', 'D3h', 'D4h') THEN 'High' WHEN rule_id IN ('C24b', 'C24c') THEN 'Medium' WHEN rule_id IN ('C19', 'C23b', 'C25', 'D5') THEN 'Low'
  WHEN rule_id IN ('C2', 'C5', 'C6', 'C8', 'C11', 'C12', 'C15', 'C16', 'C17', 'C18', 'C20', 'C21b', 'C26c', 'D1', 'D6') THEN 'N/A' ELSE 'Normal' END"""
#: Message templates; they are the engine's own wording and no rule.
MESSAGE = "CASE rule_id " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in {
        "C1": "Readable text outweighs the caption model", "C2": "Document is handwritten", "C3": "Caption model confirms printed text", "C4": "Very readable text outweighs handwriting",
        "C5": "Document appears handwritten", "C6": "Text is unreadable", "C7": "Readable text outweighs the caption model", "C8": "Document is handwritten", "C9": "Caption model confirms printed text",
        "C10": "Readable text outweighs handwriting", "C11": "Document appears handwritten", "C12": "Document is handwritten", "C13": "Caption model confirms printed text", "C14": "Caption model confirms printed text",
        "C15": "Handwritten text throughout the document", "C16": "Handwritten text throughout the document", "C17": "Resolution is too low", "C18": "Document is extremely blurry", "C19": "Blurry but partly readable",
        "C20": "Document is too blurry", "C21b": "Critical failure", "C22": "All signals are good", "C23a": "Signatures in isolated areas", "C23b": "Isolated handwriting, text hard to read",
        "C24a": "Readable text with isolated handwriting", "C24b": "Readable text, handwriting all over", "C24c": "Readable text, handwriting of unclear spread", "C25": "Sharp image but unusual font",
        "C26a": "Handwriting measure unreliable on a soft image", "C26b": "Readable text with isolated handwriting", "C26c": "Handwritten text throughout the document", "C26d": "Readable text with some handwriting",
        "D1": "Critical failures", "D2h": "Very readable", "D2n": "Very readable", "D3h": "Readable", "D3n": "Readable", "D4h": "Good score", "D4n": "Good score", "D5": "Score in the review band", "D6": "Score too low",
    }.items()
) + " END"


def laddered(opinion: str = "CAST(NULL AS BOOLEAN)", source: str = "filt") -> str:
    return f"""
pre AS (SELECT *, {opinion} AS f, CASE WHEN blur < 30 AND ocr >= 30 AND ocr < 50 THEN NULL ELSE hw END AS h,
    len(list_filter(c1 || c2 || c3, lambda x: NOT (ocr >= 80 AND x IN ('blur', 'handwriting_spread')))) AS n_all,
    len(list_filter(c1 || c2 || c3, lambda x: x NOT IN ('blur', 'handwriting_spread'))) AS n_other FROM {source}),
con AS (SELECT *, {CONSENSUS} AS consensus_rule, len(crit) > 0 AS has_critical0 FROM pre)"""


LADDER = laddered()
DECIDE = f"""
ruled AS (SELECT * EXCLUDE (has_critical0), has_critical0 AS has_critical FROM con),
pd0 AS (SELECT *, CASE WHEN consensus_rule IN ('C27', 'C21a') THEN {SCORED} ELSE consensus_rule END AS rule_id FROM ruled),
pd1 AS (SELECT *, {STATUS} AS status, {PRIORITY} AS priority, {MESSAGE} AS message FROM pd0),
pd AS (SELECT * EXCLUDE (has_critical), has_critical OR (rule_id LIKE 'C%' AND status = 'REJECTED') AS has_critical FROM pd1)"""
PAGES = ",".join([STAGED, FILTER, LADDER, DECIDE])

BEST = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
    CASE WHEN total_pages = 2 THEN -page_number ELSE 0 END,
    CASE WHEN total_pages <> 2 AND NOT has_critical THEN 0 ELSE 1 END, final_score DESC, page_number) AS place,
    count(*) FILTER (WHERE status = 'ACCEPTED') OVER (PARTITION BY doc_id) AS accepted_pages FROM pd),
best AS (SELECT *, page_number AS best_page FROM ranked WHERE place = 1)"""
DOCS = PAGES + "," + BEST + """,
dd AS (SELECT * EXCLUDE (status, priority),
    CASE WHEN total_pages >= 3 AND status <> 'ACCEPTED' AND accepted_pages > 0 THEN 'ACCEPTED' ELSE status END AS status,
    CASE WHEN total_pages >= 3 AND status <> 'ACCEPTED' AND accepted_pages > 0 THEN 'Normal' ELSE priority END AS priority,
    CASE WHEN total_pages >= 2 AND status = 'ACCEPTED' THEN 'accepted_prefix' WHEN total_pages >= 3 AND accepted_pages > 0 THEN 'accepted_pages'
      WHEN total_pages >= 3 THEN 'rejected_all' ELSE 'page' END AS message_kind FROM best)"""
ITEMS = DOCS + f""",
items AS (SELECT doc_id, total_pages, accepted_pages,
    CASE WHEN total_pages > 1 AND accepted_pages > 0 THEN 'ACCEPTED' WHEN total_pages > 1 THEN 'REJECTED' ELSE status END AS status,
    CASE WHEN total_pages > 1 AND accepted_pages > 0 THEN 'pages_passed' WHEN total_pages > 1 THEN 'all_failed' WHEN len(crit) > 0 THEN crit[1] ELSE message END AS reason,
    {r2('final_score')} AS score, ocr AS ocr_confidence FROM dd)"""
BAND = "CASE WHEN score >= 70 THEN 'acceptable' WHEN score >= 50 THEN 'review' ELSE 'too_low' END"
WORDS = """
w AS (SELECT doc_id, 1 AS page_number, CAST(i - 1 AS INT) AS word_idx, CAST((i - 1) // 50 + 1 AS INT) AS block_num, l[i] AS text, CAST((length(l[i]) * 37 + (i - 1) * 11 + doc_id * 7) % 101 AS INT) AS conf
  FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS l FROM documents), unnest(range(1, len(l) + 1)) t(i))"""
OCR = WORDS + f""",
st AS (SELECT doc_id, page_number, {r2('CAST(sum(conf) AS DOUBLE) / count(*)')} AS ocr, count(*) FILTER (WHERE conf >= 70) AS hi_words,
    count(DISTINCT block_num) FILTER (WHERE block_num > 0) AS regions, CAST(sum(length(trim(text))) AS BIGINT) AS chars, count(*) AS words
  FROM w WHERE trim(text) <> '' GROUP BY ALL)"""
MT = f"mt AS ({R.MARKER_TEXT})"


def hits(words: list[str], text: str = "t") -> str:
    return " + ".join(f"contains({text}, '{w}')::INT" for w in words)


def found(words: list[str]) -> str:
    inner = ", ".join(f"CASE WHEN contains(lower(text), '{m}') OR contains(text, '{m}') THEN '{m}' END" for m in words)
    return f"list_filter([{inner}], lambda x: x IS NOT NULL)"


HM = f"ht AS ({R.HEADER_TEXT}), hm AS (SELECT doc_id, list(DISTINCT m) AS hl FROM ht, (VALUES {', '.join(f"('{m}')" for m in HEADER)}) v(m) WHERE contains(lower(text), lower(m)) OR contains(text, m) GROUP BY doc_id)"
NO_HM = "hm AS (SELECT CAST(NULL AS BIGINT) AS doc_id, CAST([] AS VARCHAR[]) AS hl WHERE false)"


def joined(expr: str) -> str:
    return f"array_to_string(list_sort({expr}), ',')"


CAP = f"""
cap AS (SELECT *, lower(explanation) AS t FROM ({R.CAPTIONS})),
cs AS (SELECT *, {hits(PRINTED_STRONG)} AS ps, {hits(HANDWRITTEN_STRONG)} AS hs, {hits(PRINTED_WEAK)} AS pw, {hits(HANDWRITTEN_WEAK)} AS hk, ({hits(SIGNATURE)}) > 0 AS sig, ({hits(PRINTED_TEXT)}) > 0 AS txt FROM cap),
cb AS (SELECT *, CASE WHEN hs > 0 THEN 1 WHEN ps >= 2 AND hs * 3 + hk = 0 THEN 2 WHEN sig AND txt AND ps >= 1 THEN 3 WHEN ps * 3 + pw > (hs * 3 + hk) * 3 AND ps >= 1 THEN 4
    WHEN hs * 3 + hk > ps * 3 + pw THEN 5 WHEN ps * 3 + pw > (hs * 3 + hk) * 2 AND ps >= 1 THEN 6 ELSE 7 END AS caption_branch FROM cs),
cp AS (SELECT *, caption_branch IN (2, 3, 4, 6) AS is_printed, round_even(CAST(CASE caption_branch WHEN 1 THEN least({D_(0.95)}, {D_(0.7)} + hs * {D_(0.1)}) WHEN 2 THEN least({D_(0.95)}, {D_(0.75)} + ps * {D_(0.05)})
    WHEN 3 THEN {D_(0.8)} WHEN 4 THEN least({D_(0.9)}, {D_(0.65)} + ps * {D_(0.05)}) WHEN 5 THEN least({D_(0.9)}, {D_(0.6)} + (hs * 3 + hk) * {D_(0.05)}) WHEN 6 THEN {D_(0.7)} ELSE {D_(0.5)} END AS DOUBLE) * 1000, 0) / 1000 AS caption_confidence FROM cb)"""
GATE = "coalesce(ocr >= 50 AND hw >= 20 AND NOT (ocr >= 90 AND hw < 50) AND ocr >= CASE WHEN hw >= 40 THEN 70 WHEN hw >= 35 THEN 65 WHEN hw >= 30 THEN 60 ELSE 50 END, false)"
OVERRIDE = PM + "," + CAP + f""",
asked_of AS (SELECT pm.doc_id, pm.page_number, ocr, hw, is_printed, caption_confidence, timed_out, failed FROM pm JOIN cp ON cp.doc_id = pm.doc_id AND cp.page_number = pm.page_number),
ov AS (SELECT *, {GATE} AS asked, greatest({D_(0.60)}, CASE WHEN hw >= 40 THEN {D_(0.75)} WHEN hw >= 35 THEN {D_(0.70)} WHEN hw >= 30 THEN {D_(0.65)} ELSE {D_(0.60)} END - CASE WHEN ocr >= 80 THEN {D_(0.10)} WHEN ocr >= 75 THEN {D_(0.05)} ELSE {D_(0)} END) AS need FROM asked_of)"""
_SAID = "CASE WHEN NOT asked THEN NULL WHEN timed_out THEN CASE WHEN hw > 35 THEN false WHEN ocr >= 75 AND hw < 35 THEN true ELSE false END WHEN failed THEN NULL WHEN NOT is_printed THEN false WHEN caption_confidence >= need THEN true END"
_OPINION = OVERRIDE.replace(R.CAPTIONS, R.PAGE_CAPTIONS)[len(PM) + 1 :]
PAGES_SAID = ",".join([STAGED, FILTER, _OPINION, f"fo AS (SELECT doc_id, page_number, {_SAID} AS f0 FROM ov), filt2 AS (SELECT filt.*, f0 FROM filt JOIN fo USING (doc_id, page_number))", laddered("f0", "filt2"), DECIDE])
NEG = MT + f""",
neg(m) AS (VALUES {', '.join(f"('{m}')" for m in NEGATIVE)}),
wd AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(trim(lower(text)), '\\s+')) AS word FROM mt),
vo AS (SELECT DISTINCT word, list_distinct(string_split(word, '')) AS letters FROM wd),
nearw AS (SELECT word, m FROM vo, neg WHERE length(m) > 4 AND length(word) >= length(m) * {D_(0.7)} AND CAST(len(list_intersect(letters, list_distinct(string_split(m, '')))) AS DOUBLE) / len(list_distinct(string_split(m, ''))) >= {D_(0.8)}),
ex AS (SELECT doc_id, m FROM mt, neg WHERE contains(lower(text), m)),
pt AS (SELECT DISTINCT doc_id, m FROM wd JOIN nearw USING (word) EXCEPT SELECT doc_id, m FROM ex),
ns AS (SELECT mt.doc_id, text, (SELECT count(*) FROM ex WHERE ex.doc_id = mt.doc_id) AS n_exact, (SELECT count(*) FROM pt WHERE pt.doc_id = mt.doc_id) AS n_partial,
  (SELECT array_to_string(list_sort(list(m)), ',') FROM ex WHERE ex.doc_id = mt.doc_id) AS exact, (SELECT array_to_string(list_sort(list(m)), ',') FROM pt WHERE pt.doc_id = mt.doc_id) AS partial FROM mt)"""
PIX = "px AS (SELECT vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(floor(least(255, greatest(0, (CAST(embedding[i] AS DOUBLE) * 4 + 0.5::DOUBLE) * 255))) AS BIGINT) AS v FROM embeddings, unnest(range(1, 65)) t(i))"


def var(x: str) -> str:
    return f"(CAST(count({x}) * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE) / CAST(count({x}) * count({x}) AS DOUBLE))"


def page(columns: str, source: str = "s1", upto: str = STAGED) -> str:
    return f"WITH {upto} SELECT doc_id, page_number, {columns} FROM {source}"


def cat(x: str) -> str:
    return f"array_to_string({x}, ',')"


def metric_check(name: str) -> str:
    return page(f"k_{name} AS kind")


_CV = f"sqrt({var('gap')}) / (CAST(sum(gap) AS DOUBLE) / count(gap)) * 100"
REFLECT = "CASE WHEN {p} < 0 THEN 1 WHEN {p} > 7 THEN 6 ELSE {p} END"
VISUAL_SCORE = f"(CASE WHEN peak_count > 20 AND peak_count < 200 THEN {D_(0.5)} ELSE {D_(0)} END + CASE WHEN coalesce(regexp_matches(barcode_data, '[0-9]') AND length(barcode_data) > 8, false) THEN {D_(0.6)} ELSE {D_(0)} END + CASE WHEN seal_count BETWEEN 1 AND 5 THEN {D_(0.4)} + seal_count * {D_(0.1)} ELSE {D_(0)} END + CASE WHEN h_lines > width * 3 AND v_lines > height * 2 THEN {D_(0.5)} ELSE {D_(0)} END)"
VISUAL_MARKERS = "list_filter([CASE WHEN peak_count > 20 AND peak_count < 200 THEN 'barcode_top_section' END, CASE WHEN regexp_matches(barcode_data, '[0-9]') AND length(barcode_data) > 8 THEN 'barcode_decoded' END, CASE WHEN seal_count BETWEEN 1 AND 5 THEN CAST(seal_count AS VARCHAR) || '_official_seals' END, CASE WHEN h_lines > width * 3 AND v_lines > height * 2 THEN 'dense_table_grid' END], lambda x: x IS NOT NULL)"
EXT = "lower(list_extract(string_split(filename, '.'), -1))"
_PATH = r"coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '')"

ORACLE = {
    **{f"check_{n}": metric_check(n) for n in NAMES},
    "stage1_score": page(f"s1_score, {cat('c1')} AS critical, {cat('w1')} AS warnings"),
    "ocr_page_stats": f"WITH {OCR} SELECT * FROM st",
    "stage2_score": f"WITH {OCR}, pm AS (SELECT *, 800 AS width, 600 AS height, 100.0 AS blur, 100.0 AS brightness, 100.0 AS contrast, 0.0 AS white_space, 0.0 AS skew, 0.0 AS thick, 0.0 AS irregularity FROM st), {S1}, {S2} SELECT doc_id, page_number, s2_score, {cat('c2')} AS critical, {cat('w2')} AS warnings FROM s2",
    "handwriting_pct": f"WITH {PM} SELECT doc_id, page_number, {r2(f'stroke * {D_(0.35)} + baseline * {D_(0.15)} + spacing * {D_(0.30)} + component * {D_(0.20)}')} AS hw FROM pm",
    "stage3_ladder": page(f"s3_branch, s3_score, s3_action, {cat('c3')} AS critical, {cat('w3')} AS warnings", "s3"),
    "stage4_bands": page(f"s4_score, quality_level, {cat('w4')} AS warnings", "s4"),
    "final_score": page("final_score", "fin"),
    "failure_filter": page(f"{cat('crit')} AS critical, {cat('warn')} AS warnings", "filt", STAGED + "," + FILTER),
    "consensus_rule": page("consensus_rule", "con", ",".join([STAGED, FILTER, LADDER])),
    "score_status": f"WITH {STAGED}, x AS (SELECT doc_id, page_number, final_score, ocr, false AS has_critical FROM fin) SELECT doc_id, page_number, {SCORED} AS rule_id FROM x",
    "page_decision": page("rule_id, status, priority, message, final_score, has_critical", "pd", PAGES),
    "best_page": f"WITH {PAGES}, {BEST} SELECT doc_id, total_pages, best_page, final_score, rule_id, accepted_pages FROM best",
    "document_decision": f"WITH {DOCS} SELECT doc_id, total_pages, status, priority, message_kind, final_score, CASE WHEN status = 'ACCEPTED' THEN 0 ELSE len(crit) + len(warn) END AS n_reasons FROM dd",
    "bulk_items": f"WITH {ITEMS} SELECT * FROM items",
    "bulk_report": f"WITH {ITEMS} SELECT doc_id, total_pages AS pages, score, ocr_confidence, reason, {BAND} AS band FROM items",
    "score_band": f"WITH {ITEMS} SELECT {BAND} AS band, count(*) AS n FROM items GROUP BY 1",
    "batch_summary": f"WITH {ITEMS} SELECT doc_id % 97 AS batch_id, count(*) AS total, count(*) FILTER (WHERE doc_id % 13 <> 0) AS successful, count(*) FILTER (WHERE doc_id % 13 = 0) AS failed, count(*) FILTER (WHERE doc_id % 13 <> 0 AND status = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE doc_id % 13 <> 0 AND status = 'REJECTED') AS rejected, count(*) FILTER (WHERE doc_id % 13 <> 0 AND status = 'FLAG_FOR_REVIEW') AS flagged FROM items GROUP BY 1",
    "batch_cap": f"WITH u AS ({R.UPLOADS}) SELECT batch_id, count(*) AS files, count(*) > 50 AS refused, least(count(*), 50) AS shown FROM u GROUP BY 1",
    "allowed_file": f"WITH u AS ({R.UPLOADS}) SELECT item_idx, contains(filename, '.') AND {EXT} IN ('pdf', 'png', 'jpg', 'jpeg') AS allowed, regexp_matches(lower(filename), '\\.(png|jpg|jpeg|bmp|tiff|tif)$') AS is_image, ends_with(lower(filename), '.pdf') AS is_pdf FROM u",
    "size_limit": f"WITH u AS ({R.UPLOADS}) SELECT item_idx, length > 10485760 AS too_large FROM u",
    "auth_check": f"WITH u AS ({R.UPLOADS}) SELECT item_idx, (CASE WHEN item_idx % 3 = 0 THEN NULL ELSE 't' || CAST(item_idx % 2 AS VARCHAR) END) IS NOT DISTINCT FROM (CASE WHEN item_idx % 4 = 0 THEN NULL ELSE 't1' END) AS authorised FROM u",
    "filenames_match": "SELECT user_id AS batch_id, count(*) = count(*) FILTER (WHERE event_type <> (SELECT min(event_type) FROM events)) AS matches FROM events GROUP BY 1",
    "bulk_url_zip": f"WITH u AS ({R.URLS}), b AS (SELECT page_id // 50 AS batch_id, list(url ORDER BY page_id) AS urls, list('n' || CAST(page_id AS VARCHAR) ORDER BY page_id) AS names FROM u GROUP BY 1) SELECT batch_id, CAST(i - 1 AS INT) AS idx, urls[i] AS url, names[i] AS filename FROM b, unnest(range(1, len(urls) + 1)) t(i)",
    "url_extension": f"WITH u AS ({R.URLS}), p AS (SELECT page_id, content_type, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AS valid, {_PATH} AS path FROM u), e AS (SELECT *, CASE WHEN contains(path, '.') AND lower(list_extract(string_split(path, '.'), -1)) IN ('pdf', 'png', 'jpg', 'jpeg', 'bmp', 'tiff', 'tif') THEN lower(list_extract(string_split(path, '.'), -1)) END AS from_url, CASE lower(trim(string_split(content_type, ';')[1])) WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'png' WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/tiff' THEN 'tiff' END AS from_type FROM p) SELECT page_id, valid, from_url, from_type, coalesce(from_url, from_type, 'pdf') AS extension FROM e",
    "caption_parse": f"WITH {CAP} SELECT doc_id, caption_branch, is_printed, caption_confidence FROM cp",
    "caption_gate": f"WITH {PM} SELECT doc_id, page_number, {GATE} AS asked FROM pm",
    "caption_override": f"WITH {OVERRIDE} SELECT doc_id, page_number, {_SAID} AS f FROM ov",
    "text_markers": f"WITH {MT} SELECT doc_id, {joined(found(CRITICAL))} AS critical, {joined(found(STRONG))} AS strong, {joined(found(SUPPORTING))} AS supporting, contains(text, 'सूची') AND (contains(text, 'क्र') OR contains(text, '2') OR contains(lower(text), 'ii')) AS partial_header, regexp_matches(lower(text), 'regn[:\\s\\.]*63[mM]?') AS regn, length(trim(text)) < 100 AS gated FROM mt",
    "header_markers": f"WITH {HM} SELECT d.doc_id, coalesce(array_to_string(list_sort(hl), ','), '') AS header FROM documents d LEFT JOIN hm USING (doc_id)",
    "page_text": f"WITH o AS ({R.OCR_PASSES}), p AS (SELECT doc_id, page_number, {', '.join(f"max(text) FILTER (WHERE pass = {k} AND regexp_matches(text, '[^ \\n\\t\\r\\f]')) AS p{k}" for k in (1, 2, 3, 4))} FROM o GROUP BY ALL) SELECT doc_id, page_number, coalesce(CASE WHEN p1 IS NOT NULL OR p2 IS NOT NULL THEN concat_ws(chr(10), p1, p2) END, p3, p4, '') AS text FROM p",
    "negative_signals": f"WITH {NEG} SELECT doc_id, coalesce(exact, '') AS neg_exact, coalesce(partial, '') AS neg_partial FROM ns",
    "visual_indicators": f"WITH v AS ({R.PAGE_VISUALS}) SELECT doc_id, {cat(VISUAL_MARKERS)} AS markers, {VISUAL_SCORE} AS visual_score FROM v",
    "pixel_brightness": f"WITH {PIX} SELECT vec_id, CAST(sum(v) AS DOUBLE) / count(v) AS brightness FROM px GROUP BY 1",
    "pixel_contrast": f"WITH {PIX} SELECT vec_id, sqrt({var('v')}) AS contrast FROM px GROUP BY 1",
    "pixel_white_space": f"WITH {PIX} SELECT vec_id, CAST(count(*) FILTER (WHERE v > 240) * 100 AS DOUBLE) / count(*) AS white_space FROM px GROUP BY 1",
    "pixel_laplacian_blur": f"WITH {PIX}, l AS (SELECT c.vec_id, a.v + b.v + d.v + e.v - 4 * c.v AS l FROM px c JOIN px a ON a.vec_id = c.vec_id AND a.x = c.x AND a.y = {REFLECT.format(p='(c.y - 1)')} JOIN px b ON b.vec_id = c.vec_id AND b.x = c.x AND b.y = {REFLECT.format(p='(c.y + 1)')} JOIN px d ON d.vec_id = c.vec_id AND d.y = c.y AND d.x = {REFLECT.format(p='(c.x - 1)')} JOIN px e ON e.vec_id = c.vec_id AND e.y = c.y AND e.x = {REFLECT.format(p='(c.x + 1)')}) SELECT vec_id, {var('l')} AS blur FROM l GROUP BY 1",
    "row_projection_cv": f"WITH {PIX}, r AS (SELECT vec_id, y, count(*) FILTER (WHERE v < 128) AS n FROM px GROUP BY ALL), q AS (SELECT *, max(n) OVER (PARTITION BY vec_id) AS most FROM r), g AS (SELECT vec_id, CAST(y - lag(y) OVER (PARTITION BY vec_id ORDER BY y) AS BIGINT) AS gap FROM q WHERE n * 10 > most * 3), s AS (SELECT vec_id, least({_CV} * {D_(1.5)}, {D_(60)}) AS b FROM g GROUP BY 1 HAVING count(gap) > 0) SELECT e.vec_id, coalesce(b, {D_(0)}) AS baseline FROM embeddings e LEFT JOIN s USING (vec_id)",
    "col_projection_cv": f"WITH {PIX.replace('// 8', '// 64').replace('% 8', '% 64')}, r AS (SELECT vec_id, x, count(*) FILTER (WHERE v < 128) AS n FROM px GROUP BY ALL), q AS (SELECT *, max(n) OVER (PARTITION BY vec_id) AS most FROM r), g0 AS (SELECT vec_id, CAST(x - lag(x) OVER (PARTITION BY vec_id ORDER BY x) AS BIGINT) AS gap FROM q WHERE n * 10 < most), g AS (SELECT * FROM g0 WHERE gap > 5), s AS (SELECT vec_id, least({_CV}, {D_(100)}) AS b FROM g GROUP BY 1) SELECT e.vec_id, coalesce(b, {D_(0)}) AS spacing FROM embeddings e LEFT JOIN s USING (vec_id)",
    "stage_catalog": "SELECT * FROM (VALUES (1, 'Basic Quality Checks', 'OpenCV', '50-100ms', 0.35::DOUBLE, 'Resolution|Blur Detection|Brightness|Contrast|White Space|Skew Detection', 6), (2, 'OCR Confidence Analysis', 'Tesseract OCR', '2-5 seconds', 0.40::DOUBLE, 'Average Confidence|High Confidence Words|Text Regions|Character Count', 4), (3, 'Handwriting Detection', 'Computer Vision', '0.5-2 seconds', 0.20::DOUBLE, 'Stroke Width Variance|Baseline Variance|Character Spacing|Connected Components', 4), (4, 'Overall Quality Score', 'BRISQUE', '100-200ms', 0.05::DOUBLE, 'Blind Image Quality Assessment', 1)) t(stage, name, technology, processing_time, weight, checks, n_checks)",
    "health": "SELECT 'healthy' AS status, 'Document Quality Verification Pipeline' AS service, '1.0.0' AS version",
    "shown_slices": f"SELECT d.doc_id, array_to_string(list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 20), ' ') AS words, substring(repeat(explanation, 12), 1, 200) AS explanation FROM documents d JOIN ({R.CAPTIONS}) c USING (doc_id)",
    "result_json": f"WITH {ITEMS} SELECT doc_id, status, score FROM items",
    "field_extraction": "WITH f AS (SELECT doc_id, 'first_word' AS field_name, lower(regexp_extract(text, '^[^ \n]+')) AS expected_value, lower(regexp_split_to_array(text, '[ \n,.]+')[1]) AS extracted_value, 0.95::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR), CAST(length(trim(text)) AS VARCHAR), 0.8::DOUBLE FROM documents) SELECT *, expected_value IS NOT DISTINCT FROM extracted_value AS matches FROM f",
    "daily_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
ORACLE["stream_batch_summary"] = ORACLE["daily_counts"]

INDEX2 = NEG + f""",
{NO_HM},
ti AS (SELECT ns.*, {found(CRITICAL)} AS cm, {found(STRONG)} AS sm, {found(SUPPORTING)} AS um, (contains(text, 'सूची') AND (contains(text, 'क्र') OR contains(text, '2') OR contains(lower(text), 'ii')))::INT + regexp_matches(lower(text), 'regn[:\\s\\.]*63[mM]?')::INT AS extra, coalesce(hl, CAST([] AS VARCHAR[])) AS hl FROM ns LEFT JOIN hm USING (doc_id)),
th AS (SELECT *, CASE WHEN len(cm) + extra = 0 THEN hl ELSE CAST([] AS VARCHAR[]) END AS fh FROM ti),
vis AS (SELECT doc_id, {VISUAL_MARKERS} AS vm, {VISUAL_SCORE} AS visual_score FROM ({R.PAGE_VISUALS})),
tv AS (SELECT th.*, coalesce(vm, CAST([] AS VARCHAR[])) AS vm, coalesce(visual_score, {D_(0)}) AS visual_score, len(cm) * {D_(2.0)} + extra * {D_(1.8)} + len(fh) * {D_(2.0)} + len(sm) * {D_(0.6)} + len(um) * {D_(0.3)} AS text_score,
    len(list_intersect(cm || fh, [{', '.join(f"'{m}'" for m in DEFINITIVE)}])) > 0 AS definitive, len(cm) + extra + len(fh) > 0 AS critical, len(cm) + extra + len(fh) + len(sm) + len(um) AS indicators,
    n_exact * {D_(0.4)} + n_partial * {D_(0.3)} AS penalty, n_exact + n_partial AS n_neg,
    len(list_filter(string_split(coalesce(exact, '') || ',' || coalesce(partial, ''), ','), lambda m: {' OR '.join(f"contains(m, '{s}')" for s in STRONG_NEGATIVE)})) > 0 AS strong_neg
  FROM th LEFT JOIN vis USING (doc_id)),
cr AS (SELECT *, CASE WHEN length(trim(text)) < 100 THEN 'GATE' WHEN strong_neg AND NOT definitive THEN 'R0' WHEN definitive THEN 'R1' WHEN critical AND n_neg > 0 THEN 'R1B' WHEN len(sm) >= 3 AND visual_score > 1.0 THEN 'R2'
    WHEN len(list_filter(vm, lambda m: starts_with(m, 'barcode'))) > 0 AND list_contains(vm, 'dense_table_grid') AND len(um) >= 2 AND n_neg = 0 AND indicators >= 2 THEN 'R3' ELSE 'R4' END AS confidence_rule FROM tv),
cf AS (SELECT *, CASE confidence_rule WHEN 'GATE' THEN {D_(0)} WHEN 'R0' THEN greatest({D_(0)}, {D_(0.20)} - penalty) WHEN 'R1' THEN {D_(0.85)} + least({D_(0.1)}, visual_score * {D_(0.02)}) WHEN 'R1B' THEN greatest({D_(0)}, {D_(0.25)} - penalty)
    WHEN 'R2' THEN {D_(0.65)} + text_score * {D_(0.05)} WHEN 'R3' THEN {D_(0.70)} ELSE least({D_(0.55)}, (text_score * {D_(0.7)} + visual_score * {D_(0.3)}) / {D_(3.0)}) END AS confidence,
    CASE WHEN confidence_rule = 'GATE' THEN 'early_handwriting_detection' WHEN critical THEN 'Text markers (CRITICAL found)' WHEN indicators > len(vm) THEN 'Text markers' ELSE 'Visual structure' END AS method FROM cr)"""
_INDEX2_OUT = "SELECT doc_id, confidence_rule, round_even(confidence * 1000, 0) / 1000 AS confidence, confidence >= 0.60::DOUBLE AS is_index2, method FROM cf"
ORACLE["index2_confidence"] = f"WITH {INDEX2} {_INDEX2_OUT}"
ORACLE["index2_confidence_clean"] = f"WITH {INDEX2.replace(R.MARKER_TEXT, R.MARKER_TEXT_CLEAN)} {_INDEX2_OUT}"
ORACLE["index2_confidence_header"] = f"WITH {INDEX2.replace(R.MARKER_TEXT, R.MARKER_TEXT_CLEAN).replace(NO_HM, HM)} {_INDEX2_OUT}"
_HEADER3 = " OR ".join(f"contains(lower(text), '{m}')" for m in ("सूची", "index", "regn"))
_KEYS7 = " OR ".join(f"contains(lower(text), '{m}')" for m in PRINTED_KEYWORDS)
VALIDATE = INDEX2 + "," + CAP + "," + WORDS + f""",
vo2 AS (SELECT doc_id, coalesce({r2('CAST(sum(conf) FILTER (WHERE conf >= 0) AS DOUBLE) / count(*) FILTER (WHERE conf >= 0)')}, {D_(0)}) AS ocr, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS text_length, count(*) FILTER (WHERE trim(text) <> '') AS word_count FROM w GROUP BY 1),
vs AS (SELECT cf.doc_id, cf.text, len(cm) + extra + len(sm) + len(um) + len(vm) AS n_markers, confidence, confidence >= 0.60::DOUBLE AS is_index2, ocr, is_printed, caption_confidence,
    (coalesce(has_barcode, false)::INT + coalesce(has_seal, false)::INT + coalesce(has_table, false)::INT + ({_HEADER3})::INT) * 25 AS structure
  FROM cf JOIN vo2 USING (doc_id) JOIN cp USING (doc_id) LEFT JOIN ({R.PAGE_VISUALS}) v USING (doc_id)),
hb AS (SELECT *, CASE WHEN ocr >= 70 THEN 1 WHEN is_printed AND caption_confidence > 0.6::DOUBLE THEN 2 WHEN NOT is_printed AND caption_confidence > 0.7::DOUBLE THEN 3 WHEN ocr >= 50 THEN 4 ELSE 5 END AS hand_branch FROM vs),
hh AS (SELECT *, CASE WHEN hand_branch IN (1, 2, 4) THEN false WHEN hand_branch = 3 THEN NOT ocr >= 60 ELSE NOT ({_KEYS7}) END AS is_handwritten FROM hb),
vd0 AS (SELECT *, {r2(f"least({D_(100)}, ocr * {D_(1.5)}) * {D_(0.4)} + structure * {D_(0.4)} + CASE WHEN is_handwritten THEN {D_(0)} ELSE {D_(100)} END * {D_(0.2)}")} AS sc FROM hh),
vd AS (SELECT *, CASE WHEN ocr < 30 THEN ocr WHEN is_handwritten THEN {D_(0)} ELSE sc END AS index2_score, CASE WHEN ocr >= 30 AND NOT is_handwritten AND sc >= 50 THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM vd0),
rt AS (SELECT *, CASE WHEN is_index2 AND round_even(confidence * 1000, 0) / 1000 >= 0.6::DOUBLE THEN 'index2' ELSE 'general' END AS route FROM vd)"""
ORACLE["validator_ocr"] = f"WITH {WORDS}, x AS (SELECT doc_id, page_number, {r2('CAST(sum(conf) AS DOUBLE) / count(*)')} AS confidence, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS text_length, count(*) FILTER (WHERE trim(text) <> '') AS word_count FROM w GROUP BY ALL) SELECT *, text_length > 50 AS has_content FROM x"
ORACLE["validator_score"] = f"WITH {VALIDATE} SELECT doc_id, structure, hand_branch, is_handwritten, index2_score, decision FROM vd"
ORACLE["index2_route"] = f"WITH {VALIDATE} SELECT doc_id, route, CASE WHEN route = 'index2' AND decision = 'REJECT' AND is_handwritten THEN 'GENERAL' WHEN route = 'index2' THEN 'INDEX2' ELSE 'GENERAL' END AS document_type FROM rt"
_ONE = "CAST(round(CAST({} AS DECIMAL(18, 2)), 1) AS VARCHAR)".format
ORACLE["index2_message"] = f"""WITH {VALIDATE}, m AS (SELECT *, CASE WHEN decision = 'ACCEPT' THEN NULL WHEN ocr < 30 THEN 'Text completely unreadable (OCR: ' || {_ONE('ocr')} || '%)' WHEN is_handwritten THEN 'Document is fully handwritten'
    ELSE 'Quality below minimum threshold (score: ' || {_ONE('index2_score')} || ')' END AS rejection_reason FROM vd)
SELECT doc_id, rejection_reason, CASE WHEN decision = 'ACCEPT' THEN 'Document accepted (score: ' || {_ONE('index2_score')} || '/100). Document structure verified with ' || n_markers || ' authenticity markers.'
    ELSE 'Document rejected: ' || rejection_reason || '. Score: ' || {_ONE('index2_score')} || '/100' END AS message FROM m"""
ORACLE["index2_first_page"] = f"WITH {PM} SELECT doc_id, page_number, total_pages FROM pm WHERE page_number = 1"
ORACLE["consensus_rule_captions"] = f"WITH {PAGES_SAID} SELECT doc_id, page_number, f, consensus_rule FROM con"
ORACLE["page_decision_captions"] = f"WITH {PAGES_SAID} SELECT doc_id, page_number, rule_id, status, priority, has_critical FROM pd"
ORACLE["first_override"] = f"WITH {PAGES_SAID} SELECT doc_id, min(page_number) FILTER (WHERE rule_id IN ('C3', 'C9', 'C13', 'C14')) AS override_page FROM pd GROUP BY 1"
FILES = ITEMS + f""",
sb AS (SELECT *, CASE WHEN NOT coalesce(contains(filename, '.') AND {EXT} IN ('pdf', 'png', 'jpg', 'jpeg'), false) THEN 'Invalid file type' WHEN length > 10485760 THEN 'File too large. Maximum size: 10.0MB' END AS error FROM ({R.SUBMISSIONS})),
en AS (SELECT batch_id, idx, sb.doc_id, filename, error, error IS NULL AND items.doc_id IS NOT NULL AS success, CASE WHEN error IS NULL THEN coalesce(status, 'UNKNOWN') END AS status,
    CASE WHEN error IS NULL THEN coalesce(score, {D_(0)}) END AS score, CASE WHEN error IS NULL THEN coalesce(reason, 'Needs review') END AS reason, CASE WHEN error IS NULL THEN ocr_confidence END AS ocr_confidence,
    CASE WHEN error IS NULL THEN coalesce(total_pages, 1) END AS total_pages FROM sb LEFT JOIN items ON items.doc_id = sb.doc_id AND items.doc_id % 17 <> 0)"""
ORACLE["response_entries"] = f"WITH {FILES} SELECT * FROM en"
_WHEN_OK = "CASE WHEN count(*) <= 50 THEN {} END".format
ORACLE["batch_response"] = f"""WITH {FILES} SELECT batch_id, count(*) <= 50 AS success, CASE WHEN count(*) > 50 THEN 'Too many files. Maximum 50 files allowed per bulk upload.' END AS error, {_WHEN_OK('count(*)')} AS total_files,
    {_WHEN_OK('count(*) FILTER (WHERE success)')} AS successful, {_WHEN_OK('count(error)')} AS failed, {_WHEN_OK("count(*) FILTER (WHERE status = 'ACCEPTED')")} AS accepted, {_WHEN_OK("count(*) FILTER (WHERE status = 'REJECTED')")} AS rejected,
    {_WHEN_OK("count(*) FILTER (WHERE status = 'FLAG_FOR_REVIEW')")} AS flagged_for_review, {_WHEN_OK("coalesce(string_agg(idx || ':' || status, '|' ORDER BY idx) FILTER (WHERE error IS NULL), '')")} AS results,
    {_WHEN_OK("coalesce(string_agg(idx || ':' || error, '|' ORDER BY idx) FILTER (WHERE error IS NOT NULL), '')")} AS errors FROM en GROUP BY batch_id"""
ORACLE["client_filter"] = f"""WITH sb AS ({R.SUBMISSIONS}), k AS (SELECT batch_id, doc_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS INT) AS place FROM sb
    WHERE length <= 10485760 AND ((doc_id % 11 = 0 AND doc_id % 2 = 0) OR regexp_matches(lower(filename), '\\.(pdf|png|jpg|jpeg)$'))) SELECT * FROM k WHERE place <= 50"""
_MB = "printf('%.2f', {} / 1048576.0)".format
_URL_EXT = ORACLE["url_extension"]
ORACLE["download_errors"] = f"""WITH dl AS ({R.DOWNLOADS}), ux AS ({_URL_EXT}), e AS (SELECT dl.*, extension, CASE WHEN NOT coalesce(valid, false) THEN 'Invalid URL format' WHEN failure = 'timeout' THEN 'Request timeout'
    WHEN failure = 'connection' THEN 'Connection error - could not reach the server' WHEN failure IS NOT NULL THEN 'Request error: ' || failure WHEN status >= 400 THEN 'HTTP error: ' || status || ' - ' || reason
    WHEN content_length > 10485760 THEN 'File too large (' || {_MB('content_length')} || 'MB). Maximum size: 10.00MB' WHEN length > 10485760 THEN 'File too large (' || {_MB('length')} || 'MB). Maximum size: 10.00MB' END AS error
  FROM dl JOIN ux USING (page_id)) SELECT page_id, error, extension, error IS NULL AS saved, CASE WHEN error IS NULL AND filename IS NOT NULL THEN filename || '.' || extension END AS custom_name FROM e"""
