"""SQL that gives the same rows as the registered queries, over the same tables.

Written step by step from the definitions, not from the Spark expressions.
"""

from __future__ import annotations

from shelfsift.fixed_values import (
    BRANDS,
    BUILT_IN_EXAMPLES,
    CONTRACTIONS,
    ENGLISH_STOP_WORDS,
    PROMPT_BEFORE_EXAMPLES,
    PROMPT_BEFORE_TEXT,
    PROMPT_END_LONG,
    PROMPT_END_SHORT,
    SCRIPT_HEADER,
    SEPARATORS,
    SYSTEM_PROMPT,
    TAG_PHRASES,
    TAG_SECTION_MARKERS,
    TRANSLITERATIONS,
    WORD,
)
from shelfsift.functions.text import accent_table

# The white space characters one by one (RE2 has no class for them).
WHITESPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Upper case beyond \p{Lu}: Roman numerals, circled, squared and enclosed capitals.
OTHER_UPPER = r"\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word_list(words: list[str]) -> str:
    return "[" + ", ".join(quoted(word) for word in words) + "]"


STOP_LIST = word_list(ENGLISH_STOP_WORDS)

# the hand features in the order of the assembled vector, and those of the first split
HAND_FEATURES = [
    "text_length", "clean_text_length", "word_count", "hashtag_count", "uppercase_ratio", "special_char_ratio",
    "hashtag_to_text_ratio", "contains_ignore", "contains_hashtags_at_end", "hashtag_section_length", "brand_count",
    "tag_indicators", "keyword_density", "has_tag_section",
]
ROOT_FEATURES = ["contains_ignore", "contains_hashtags_at_end", "brand_count", "tag_indicators", "has_tag_section"]


def clean(text: str) -> str:
    no_urls = f"regexp_replace(lower(coalesce({text}, '')), '(http|www)[^{WHITESPACE}]+', '', 'g')"
    words = f"regexp_replace({no_urls}, '[^{WORD}{WHITESPACE}]', ' ', 'g')"
    return f"trim(regexp_replace({words}, '[{WHITESPACE}]+', ' ', 'g'))"


def words_of(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE string_split({text}, ' ') END"


def ascii_surface(text: str) -> str:
    spelled = f"regexp_replace({text}, {quoted(SEPARATORS)}, ' ', 'g')"
    for source, target in TRANSLITERATIONS:
        if len(target) > 1:
            spelled = f"replace({spelled}, {quoted(source)}, {quoted(target)})"
    source, target = accent_table()
    spelled = f"translate({spelled}, {quoted(source)}, {quoted(target)})"
    kept = f"regexp_replace({spelled}, '[^A-Za-z0-9& ]', '', 'g')"
    return f"trim(regexp_replace({kept}, ' +', ' ', 'g'))"


def hits(text: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {quoted(phrase)})::BIGINT" for phrase in phrases) + ")"


# --- shared steps ----------------------------------------------------------------

LISTINGS = """
listings AS (
  SELECT d.doc_id AS product_id,
    CASE d.doc_id % 8
      WHEN 1 THEN d.text || ' Tags: #nike #adidas #y2k'
      WHEN 2 THEN d.text || chr(10) || 'Ignore: 80s 90s levi calvin klein h&m'
      WHEN 3 THEN d.text || ' see https://shop.example/x www.example.com'
      WHEN 4 THEN d.text || ' tagged for exposure'
      WHEN 5 THEN d.text || ' #denim #blue  '
      WHEN 6 THEN 'NIKE Supreme 1 3 5 6 7 11 12 ' || d.text
      WHEN 7 THEN d.text || ' ~ignore~ Gucci ½'
      ELSE d.text END AS description,
    CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 WHEN l.quality IS NOT NULL THEN 0 END AS label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
CLEANED = f"cleaned AS (SELECT *, {clean('description')} AS clean FROM listings)"
CLEAN_WORDS = f"clean_words AS (SELECT product_id, {words_of('clean')} AS words FROM cleaned)"
_CONTRACTED = " ".join(f"WHEN '{head}{tail}' THEN '{head} {tail}'" for head, tail in CONTRACTIONS)


def contracted(words: str) -> str:
    spread = f"array_to_string(list_transform({words}, lambda t: CASE t {_CONTRACTED} ELSE t END), ' ')"
    return words_of(spread)


TOKENS = f"tokens AS (SELECT product_id, {contracted('words')} AS tokens FROM clean_words)"


def without_stop_words(words: str) -> str:
    return f"list_filter({words}, lambda t: NOT list_contains({STOP_LIST}, lower(t)))"


# regular inflections whose base form is a word of the corpus; the first rule that fits wins
LEMMA_DICTIONARY = """
vocab AS (SELECT DISTINCT unnest(words) AS word FROM clean_words),
readings AS (
  SELECT word AS form, 0 AS rank, left(word, length(word) - 3) || 'y' AS lemma FROM vocab
    WHERE ends_with(word, 'ies') AND length(word) >= 6
  UNION ALL SELECT word, 1, left(word, length(word) - 2) FROM vocab WHERE ends_with(word, 'es') AND length(word) >= 5
  UNION ALL SELECT word, 2, left(word, length(word) - 1) FROM vocab WHERE ends_with(word, 's') AND length(word) >= 4
  UNION ALL SELECT word, 3, left(word, length(word) - 3) FROM vocab WHERE ends_with(word, 'ing') AND length(word) >= 6
  UNION ALL SELECT word, 4, left(word, length(word) - 2) FROM vocab WHERE ends_with(word, 'ed') AND length(word) >= 5),
dictionary AS (
  SELECT form, arg_min(lemma, rank) AS lemma FROM readings WHERE lemma IN (SELECT word FROM vocab) GROUP BY form)"""
# rewrites of endings by at most one character behind the same stem, scored by the words that they explain
LEARNT_LEMMAS = """
vocab AS (SELECT DISTINCT unnest(words) AS word FROM clean_words),
forms AS (
  SELECT word AS form, word[:len(word) - n] AS stem, word[len(word) - n + 1:] AS ending
  FROM vocab, (VALUES (1), (2), (3), (4)) AS v(n) WHERE len(word) >= 3 + n),
bases AS (
  SELECT word AS lemma, word AS stem, '' AS base_ending FROM vocab WHERE len(word) >= 3
  UNION ALL SELECT word, word[:len(word) - 1], word[len(word):] FROM vocab WHERE len(word) >= 4),
rewrites AS (
  SELECT form, ending, base_ending, lemma FROM forms JOIN bases USING (stem)
  WHERE base_ending = '' OR (len(ending) > 1 AND ending[1] <> base_ending)),
rules AS (
  SELECT ending, base_ending, explains, words
  FROM (SELECT ending, base_ending, count(*) AS explains FROM rewrites GROUP BY ALL)
  JOIN (SELECT ending, count(*) AS words FROM forms GROUP BY ending) USING (ending)
  WHERE explains >= 5 AND 100 * explains >= 20 * words),
learnt AS (
  SELECT form, lemma FROM rewrites JOIN rules USING (ending, base_ending)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY explains DESC, len(ending) DESC, ending, base_ending) = 1)"""
LEMMAS = f"""
spelled AS (SELECT product_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM clean_words),
lemmas AS (
  SELECT w.product_id, coalesce(string_agg(coalesce(d.lemma, s.word), ' ' ORDER BY s.pos), '') AS lemmas
  FROM clean_words w LEFT JOIN spelled s ON s.product_id = w.product_id LEFT JOIN dictionary d ON d.form = s.word
  GROUP BY w.product_id),
preprocessed AS (
  SELECT product_id, array_to_string({without_stop_words(contracted(words_of('lemmas')))}, ' ') AS preprocessed FROM lemmas)"""
PREPROCESSED = ",\n".join([LISTINGS, CLEANED, CLEAN_WORDS, LEMMA_DICTIONARY, LEMMAS])

FEATURES = f"""
cased AS (SELECT *, lower(description) AS low FROM cleaned),
features AS (
  SELECT product_id, description, label, split,
    length(description)::BIGINT AS text_length,
    length(clean)::BIGINT AS clean_text_length,
    len({words_of('clean')})::BIGINT AS word_count,
    length(regexp_replace(description, '[^#]', '', 'g'))::BIGINT AS hashtag_count,
    length(regexp_replace(description, '[^\\p{{Lu}}{OTHER_UPPER}]', '', 'g')) / greatest(length(description), 1)
      AS uppercase_ratio,
    length(regexp_replace(description, '[\\p{{L}}\\p{{N}}{WHITESPACE}]', '', 'g')) / greatest(length(description), 1)
      AS special_char_ratio,
    length(regexp_replace(description, '[^#]', '', 'g'))
      / greatest(len(list_filter(regexp_split_to_array(description, '[{WHITESPACE}]+'), lambda t: t <> '')), 1)
      AS hashtag_to_text_ratio,
    contains(low, 'ignore')::BIGINT AS contains_ignore,
    regexp_matches(description, '#[{WORD}]+[{WHITESPACE}]*$')::BIGINT AS contains_hashtags_at_end,
    (CASE WHEN contains(description, '#') THEN length(string_split(description, '#')[-1]) ELSE 0 END)::BIGINT
      AS hashtag_section_length,
    {hits('low', BRANDS)} AS brand_count,
    {hits('low', TAG_PHRASES)} AS tag_indicators,
    len(list_distinct({words_of('clean')})) / greatest(len({words_of('clean')}), 1) AS keyword_density,
    ({hits('low', TAG_SECTION_MARKERS)} > 0)::BIGINT AS has_tag_section
  FROM cased)"""
FEATURED = ",\n".join([LISTINGS, CLEANED, FEATURES])

DESCRIPTIONS = ",\n".join([CLEANED, CLEAN_WORDS, LEMMA_DICTIONARY, f"""
plain_described AS (SELECT *, {ascii_surface('lower(description)')} AS clean_description FROM listings),
plain_pieces AS (
  SELECT product_id, unnest(string_split(clean_description, ' ')) AS word,
    generate_subscripts(string_split(clean_description, ' '), 1) AS pos FROM plain_described),
lemma_texts AS (
  SELECT p.product_id, string_agg(coalesce(d.lemma, p.word), ' ' ORDER BY p.pos) AS lemma_text
  FROM plain_pieces p LEFT JOIN dictionary d ON d.form = p.word GROUP BY p.product_id),
described AS (
  SELECT p.* REPLACE (l.lemma_text AS clean_description) FROM plain_described p JOIN lemma_texts l USING (product_id))"""])
LETTERS = "letters AS (SELECT *, regexp_replace(clean_description, '[0-9]', '', 'g') AS letters FROM described)"
NOTEBOOK = f"""
pieces AS (SELECT *, string_split(clean_description, ' ') AS piece FROM described),
notebook AS (
  SELECT product_id, label,
    round(len(list_filter(piece, lambda t: list_contains({STOP_LIST}, lower(t)))) / len(piece), 6)
      AS proportion_of_stopwords,
    round(list_sum(list_transform(piece, lambda t: length(t))) / len(piece), 6) AS average_length_of_word,
    round(len(list_filter(piece, lambda t: regexp_full_match(t, '[0-9]+'))) / len(piece), 6) AS proportion_of_numbers
  FROM pieces)"""

SURFACE = f"""
surface AS (SELECT product_id, {ascii_surface('description')} AS surface FROM listings),
form_counts AS (
  SELECT form, count(*) AS n FROM (
    SELECT regexp_replace(unnest(string_split(surface, ' ')), '[0-9]', '', 'g') AS form FROM surface)
  WHERE form <> '' GROUP BY form),
forms AS (
  SELECT lower(form) AS lower_form, form AS best_form, n FROM form_counts
  QUALIFY row_number() OVER (PARTITION BY lower(form) ORDER BY n DESC, form DESC) = 1)"""
CASED = """
letter_words AS (
  SELECT product_id, unnest(string_split(letters, ' ')) AS word,
    generate_subscripts(string_split(letters, ' '), 1) AS pos FROM letters),
cased_words AS (
  SELECT w.product_id, w.pos, coalesce(f.best_form, w.word) AS word
  FROM letter_words w LEFT JOIN forms f ON f.lower_form = w.word),
first_entities AS (
  SELECT product_id, word, min(pos) AS pos FROM cased_words WHERE regexp_matches(word, '^[A-Z]')
  GROUP BY product_id, word),
entities AS (
  SELECT l.product_id, coalesce(string_agg(e.word, ' ' ORDER BY e.pos), '') AS named_entities
  FROM letters l LEFT JOIN first_entities e ON e.product_id = l.product_id GROUP BY l.product_id)"""
TRUECASED = ",\n".join([LISTINGS, DESCRIPTIONS, LETTERS, SURFACE, CASED])


def terms(source: str, text: str, pairs: bool = False, stop: bool = False) -> str:
    """One row per occurrence of a term: words of two or more characters, and pairs of neighbours."""
    words = f"regexp_extract_all(lower({text}), '[{WORD}]{{2,}}')"
    if stop:
        words = without_stop_words(words)
    steps = f"term_words AS (SELECT product_id, {words} AS words FROM {source}),\n"
    listed = "words"
    if pairs:
        listed = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    return steps + f"occurrences AS (SELECT product_id, unnest({listed}) AS term FROM term_words)"


def weights(limit: int, low: int = 0, high: float = 1.0) -> str:
    return f"""
counts AS (SELECT product_id, term, count(*) AS tf FROM occurrences GROUP BY product_id, term),
size AS (SELECT count(*) AS n FROM listings),
vocabulary AS (
  SELECT term, sum(tf)::BIGINT AS cf, count(*)::BIGINT AS df FROM counts GROUP BY term
  HAVING count(*) >= {low} AND count(*) <= {high} * (SELECT n FROM size)
  ORDER BY cf DESC, term LIMIT {limit}),
raw_weights AS (
  SELECT c.product_id, c.term, c.tf, c.tf * (ln((1.0 + n) / (1.0 + v.df)) + 1) AS weight
  FROM counts c JOIN vocabulary v ON v.term = c.term CROSS JOIN size),
weights AS (
  SELECT product_id, term, tf,
    weight / sqrt(sum(weight * weight) OVER (PARTITION BY product_id)) AS tfidf FROM raw_weights)"""


GRAMS = ",\n".join([PREPROCESSED, terms("preprocessed", "preprocessed", pairs=True), weights(5000, 2, 0.8)])
WORD_WEIGHTS = ",\n".join([LISTINGS, DESCRIPTIONS, LETTERS, terms("letters", "letters", stop=True), weights(500)])
ENTITY_WEIGHTS = ",\n".join([TRUECASED, terms("entities", "named_entities", stop=True), weights(500)])

JUDGED = FEATURED + """,
judged AS (
  SELECT product_id, label, 'tag_section' AS model, has_tag_section AS prediction FROM features WHERE label IS NOT NULL
  UNION ALL
  SELECT product_id, label, 'tag_phrases', (tag_indicators >= 2)::BIGINT FROM features WHERE label IS NOT NULL)"""


def matrix(source: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    return f"""
matrix AS (
  SELECT {by + ',' if by else ''}
    count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
  FROM {source}{group}),
scores AS (
  SELECT *, (tp + tn) / nullif(tn + fp + fn + tp, 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM matrix),
metrics AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM scores)"""


METRIC_COLUMNS = (
    "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1_score, 6) AS f1_score, tn, fp, fn, tp"
)
REPORT = """
sides AS (
  SELECT model, '0' AS class, tn AS hit, fn AS wrong, fp AS missed FROM matrix
  UNION ALL SELECT model, '1', tp, fp, fn FROM matrix),
sided AS (
  SELECT model, class, coalesce(hit / nullif(hit + wrong, 0), 0) AS precision,
    coalesce(hit / nullif(hit + missed, 0), 0) AS recall, hit + missed AS support FROM sides),
classes AS (
  SELECT model, class, precision, recall,
    coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score, support FROM sided),
report AS (
  SELECT * FROM classes
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM classes GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1_score * support) / sum(support), sum(support) FROM classes GROUP BY model)"""

PART_LEXICON = """
lexicon AS (
  SELECT DISTINCT unnest(string_split(lower(concat_ws(' ', p_name, p_brand, p_type)), ' ')) AS term FROM part),
found AS (
  SELECT l.product_id, x.term FROM listings l JOIN lexicon x ON contains(lower(l.description), x.term)
  WHERE x.term <> '')"""

FEW_SHOT = """
known AS (SELECT * FROM listings WHERE label IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || product_id), product_id) AS rank FROM known),
size_limit AS (
  SELECT least(4, count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS usable FROM known),
few_shot AS (
  SELECT row_number() OVER (ORDER BY md5('42:s:' || product_id), product_id) AS place, product_id, description,
    CASE WHEN label = 1 THEN 'Spam' ELSE 'Not Spam' END AS label
  FROM ranked, size_limit WHERE rank <= usable)"""

_SCORE = "'0.' || lpad((product_id % 100)::VARCHAR, 2, '0')"
RESPONSES = f"""
responses AS (
  SELECT product_id, CASE product_id % 13
    WHEN 0 THEN description || chr(10) || '{{"is_spam": true, "spam_score": ' || {_SCORE} || ', "reasoning": "doc ' || product_id || '"}}'
    WHEN 1 THEN '{{"is_spam": false, "spam_score": ' || {_SCORE} || '}} ' || description
    WHEN 2 THEN description
    WHEN 3 THEN '{{"is_spam": "no", "spam_score": "' || {_SCORE} || '", "reasoning": "x"}}'
    WHEN 4 THEN '{{''is_spam'': true}}'
    WHEN 5 THEN 'Sure: {{"is_spam": 1, "spam_score": 1}}'
    WHEN 6 THEN '{{"is_spam": 0.0, "reasoning": null}}'
    WHEN 7 THEN '{{"is_spam": [], "spam_score": null}}'
    WHEN 8 THEN '{{"is_spam": [0], "spam_score": 0.5,}}'
    WHEN 9 THEN '{{"spam_score": ' || {_SCORE} || ', "reasoning": {{"why":"x"}}}}'
    WHEN 10 THEN '{{"is_spam": {{}}}} t {{"b": 2}}'
    WHEN 11 THEN NULL
    WHEN 12 THEN 'not SPAM }} {{' || replace(description, '}}', '') END AS response
  FROM listings)"""


def parse(json_text: str, no_json: str) -> str:
    return f"""
found AS (SELECT *, {json_text} AS found FROM responses),
valid AS (
  -- json_valid lets a comma before a closing bracket pass, which JSON does not allow
  SELECT *, CASE WHEN json_valid(found) AND NOT regexp_matches(found, ',[ \\t\\r\\n]*[}}\\]]') THEN found::JSON END AS doc
  FROM found),
stated AS (
  SELECT *, CASE WHEN response IS NULL THEN 'error' WHEN {no_json} THEN 'no_json'
    WHEN json_type(doc) = 'OBJECT' THEN 'ok' ELSE 'error' END AS parse_status,
    contains(lower(response), 'spam') AS mentions, json_extract(doc, '$.is_spam') AS flag FROM valid),
truth AS (
  SELECT *, CASE WHEN flag IS NULL OR json_type(flag) = 'NULL' THEN false
    WHEN json_type(flag) = 'BOOLEAN' THEN flag::VARCHAR = 'true'
    WHEN json_type(flag) = 'VARCHAR' THEN flag::VARCHAR <> '""'
    WHEN json_type(flag) = 'ARRAY' THEN json_array_length(flag) > 0
    WHEN json_type(flag) = 'OBJECT' THEN len(json_keys(flag)) > 0
    ELSE flag::DOUBLE <> 0 END AS truthy FROM stated)
SELECT product_id, parse_status,
  (CASE parse_status WHEN 'ok' THEN truthy WHEN 'no_json' THEN mentions ELSE false END)::BIGINT AS is_spam,
  round(CASE parse_status WHEN 'ok' THEN coalesce(TRY_CAST(json_extract_string(doc, '$.spam_score') AS DOUBLE), 0.0)
    WHEN 'no_json' THEN CASE WHEN mentions THEN 0.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE, 6) AS spam_score,
  CASE parse_status WHEN 'ok' THEN json_extract_string(doc, '$.reasoning')
    WHEN 'no_json' THEN 'Failed to parse JSON response'
    ELSE 'Error processing with LLM: ' || CASE WHEN response IS NULL THEN 'no response' ELSE 'invalid JSON' END
    END AS reasoning
FROM truth"""


_BLOCK = "\n\n".join(f"Description: {text}\nLabel: {label}" for text, label in BUILT_IN_EXAMPLES)
_OPENING = quoted(PROMPT_BEFORE_EXAMPLES + _BLOCK + PROMPT_BEFORE_TEXT)

RULE = """
rule AS (
  SELECT product_id, description, label, (has_tag_section = 1 OR brand_count >= 2)::BIGINT AS prediction,
    least(1.0, (brand_count + tag_indicators) / 4)::DOUBLE AS spam_score,
    brand_count || ' brands, ' || tag_indicators || ' tag phrases' AS reasoning FROM features)"""
REPORT_COLUMNS = """
  CASE WHEN label = 1 THEN 'Spam' ELSE 'Not Spam' END AS actual,
  CASE WHEN prediction = 1 THEN 'Spam' ELSE 'Not Spam' END AS predicted,
  CASE WHEN length(description) > 50 THEN left(description, 47) || '...' ELSE description END AS description"""

# What each page layout of the notebook view holds, written out: (tier, cell number, code).
_CODE = "'import os' || chr(10) || '# page ' || page_id || chr(10) || 'print(\"' || url || '\")'"
CODE_CELLS = f"""
cells AS (
  SELECT page_id, 1 AS tier, 0 AS cell_ix, {_CODE} AS code FROM pages WHERE page_id % 6 = 1
  UNION ALL SELECT page_id, 1, 1, 'x = 1' || {_CODE} FROM pages WHERE page_id % 6 = 1
  UNION ALL SELECT page_id, 1, 0, 'x = 1' || {_CODE} FROM pages WHERE page_id % 6 = 2
  UNION ALL SELECT page_id, 2, 0, {_CODE} FROM pages WHERE page_id % 6 = 3
  UNION ALL SELECT page_id, 3, 0, 'y = 2' FROM pages WHERE page_id % 6 = 4)"""
_CODE_HTML = "'import os' || chr(10) || '# page ' || page_id || chr(10) || 'print(&quot;' || replace(url, '&', '&amp;') || '&quot;)'"
_CELL_HTML = (
    "'<div class=\"cell code_cell\"><div class=\"input\"><div class=\"input_area\"><pre><span>' || "
    + _CODE_HTML
    + " || '</span></pre><pre>second</pre></div></div></div>'"
)
_LAB_HTML = (
    "'<div class=\"jp-Cell jp-CodeCell\"><div class=\"jp-Cell-inputArea\"><div class=\"highlight\"><pre>x = 1<br>' || "
    + _CODE_HTML
    + " || '</pre></div></div></div>'"
)
NOTEBOOK_PAGES = f"""
notebook_pages AS (
  SELECT page_id, html || CASE page_id % 6
    WHEN 1 THEN {_CELL_HTML} || {_LAB_HTML}
    WHEN 2 THEN {_LAB_HTML}
    WHEN 3 THEN '<pre>just prose</pre><pre>' || {_CODE_HTML} || '</pre>'
    WHEN 4 THEN '<div class="highlight-python"><p>note<pre>y = 2</pre></div>'
    WHEN 5 THEN '<pre>no code here at all</pre>'
    ELSE '' END AS html FROM pages)"""
_BLANK, _ONE = f"[{WHITESPACE}]", f"[{WORD}]"
_CODE_SHAPE = (
    f"import{_BLANK}+{_ONE}|def{_BLANK}+{_ONE}+{_BLANK}*\\(|class{_BLANK}+{_ONE}+{_BLANK}*\\(|(^|\\n){_BLANK}*#"
)


def steps(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


ORACLE: dict[str, str] = {
    "clean_text": steps(LISTINGS, CLEANED) + "SELECT product_id, clean AS clean_text FROM cleaned",
    "tokens": steps(LISTINGS, CLEANED, CLEAN_WORDS, TOKENS)
    + "SELECT product_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, '|') AS tokens FROM tokens",
    "remove_stopwords": steps(LISTINGS, CLEANED, CLEAN_WORDS, TOKENS)
    + f"SELECT product_id, len({without_stop_words('tokens')})::BIGINT AS n_kept,"
    + f" array_to_string({without_stop_words('tokens')}, ' ') AS kept FROM tokens",
    "lemma_dictionary": steps(LISTINGS, CLEANED, CLEAN_WORDS, LEMMA_DICTIONARY) + "SELECT form, lemma FROM dictionary",
    "lemma_rules": steps(LISTINGS, CLEANED, CLEAN_WORDS, LEARNT_LEMMAS) + "SELECT * FROM rules",
    "lemma_learnt": steps(LISTINGS, CLEANED, CLEAN_WORDS, LEARNT_LEMMAS) + "SELECT * FROM learnt",
    "lemmatize_dict": steps(PREPROCESSED) + "SELECT product_id, lemmas FROM lemmas",
    "preprocess": steps(PREPROCESSED) + "SELECT product_id, preprocessed FROM preprocessed",
    "clean_description": steps(LISTINGS, DESCRIPTIONS) + "SELECT product_id, clean_description FROM described",
    "drop_digits": steps(LISTINGS, DESCRIPTIONS, LETTERS) + "SELECT product_id, letters FROM letters",
    "truecase_corpus": steps(LISTINGS, SURFACE) + "SELECT lower_form, best_form, n FROM forms",
    "truecase_text": steps(TRUECASED)
    + "SELECT product_id, string_agg(word, ' ' ORDER BY pos) AS cased FROM cased_words GROUP BY product_id",
    "entity_tokens": steps(TRUECASED) + "SELECT product_id, named_entities FROM entities",
    "entity_gazetteer": steps(
        LISTINGS,
        f"names AS (SELECT DISTINCT name FROM (SELECT unnest(string_split({ascii_surface('text')}, ' ')) AS name"
        " FROM benchmark) WHERE regexp_matches(name, '^[A-Z]'))",
        f"surface_words AS (SELECT product_id, unnest(string_split({ascii_surface('description')}, ' ')) AS word FROM listings)",
    )
    + "SELECT DISTINCT product_id, word AS entity FROM surface_words WHERE word IN (SELECT name FROM names)",
    "spam_features": steps(FEATURED)
    + "SELECT product_id, text_length, clean_text_length, word_count, hashtag_count,"
    " round(uppercase_ratio, 6) AS uppercase_ratio, round(special_char_ratio, 6) AS special_char_ratio,"
    " round(hashtag_to_text_ratio, 6) AS hashtag_to_text_ratio, contains_ignore, contains_hashtags_at_end,"
    " hashtag_section_length, brand_count, tag_indicators, round(keyword_density, 6) AS keyword_density,"
    " has_tag_section FROM features",
    "notebook_features": steps(LISTINGS, DESCRIPTIONS, NOTEBOOK) + "SELECT * EXCLUDE (label) FROM notebook",
    "lexicon_hits": steps(LISTINGS, PART_LEXICON)
    + "SELECT l.product_id, count(f.term) AS term_hits FROM listings l LEFT JOIN found f"
    " ON f.product_id = l.product_id GROUP BY l.product_id",
    "lexicon_terms_large": steps(LISTINGS, PART_LEXICON)
    + "SELECT term, count(*) AS listings FROM found GROUP BY term",
    "lexicon_terms": steps(LISTINGS, PART_LEXICON) + "SELECT term, count(*) AS listings FROM found GROUP BY term",
    "model_frame": steps(LISTINGS, DESCRIPTIONS, NOTEBOOK)
    + "SELECT * REPLACE (label::BIGINT AS label) FROM notebook WHERE label IS NOT NULL",
    "union_all": steps(LISTINGS)
    + "SELECT product_id, 'train' AS split, length(description)::BIGINT AS text_length FROM listings WHERE split = 'train'"
    " UNION ALL SELECT product_id, 'test', length(description) FROM listings WHERE split = 'test'",
    "split_semi": steps(LISTINGS)
    + "SELECT product_id, md5(description) AS text_md5 FROM listings WHERE product_id IN"
    " (SELECT doc_id FROM labels WHERE quality IS NOT NULL OR toxic = 1)",
    "split_anti": steps(LISTINGS)
    + "SELECT product_id, md5(description) AS text_md5 FROM listings WHERE product_id NOT IN"
    " (SELECT doc_id FROM labels WHERE quality IS NOT NULL OR toxic = 1)",
    "split_counts": steps(LISTINGS)
    + "SELECT split, label::BIGINT AS label, count(*) AS n FROM listings GROUP BY split, label",
    "head_subset": steps(LISTINGS) + "SELECT product_id, description FROM listings ORDER BY product_id LIMIT 20",
    "few_shot_balanced": steps(LISTINGS, FEW_SHOT) + "SELECT place, product_id, description, label FROM few_shot",
    "few_shot_merged": steps(LISTINGS, FEW_SHOT) + "SELECT place, product_id, description, label FROM few_shot",
    "csv_listings": steps(LISTINGS)
    + "SELECT product_id, md5(description) AS text_md5, length(description)::BIGINT AS text_length, label::BIGINT AS label"
    " FROM listings",
    "entity_gazetteer_large": steps(
        LISTINGS,
        f"passages AS (SELECT string_split({ascii_surface('text')}, ' ') AS w FROM benchmark)",
        "names AS (SELECT DISTINCT unnest(list_concat("
        "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),"
        " list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS name FROM passages)",
        f"spelled AS (SELECT product_id, string_split({ascii_surface('description')}, ' ') AS w FROM listings)",
        "runs AS (SELECT DISTINCT product_id, unnest(list_concat("
        "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),"
        " list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS entity FROM spelled)",
    )
    + "SELECT product_id, entity FROM runs WHERE entity IN (SELECT name FROM names)",
    "prediction_report": steps(FEATURED)
    + "SELECT row_number() OVER (ORDER BY product_id) AS row_number, product_id,"
    + REPORT_COLUMNS.replace("prediction", "has_tag_section")
    + " FROM features WHERE label IS NOT NULL",
    "ngrams": steps(LISTINGS, terms("listings", "description"))
    + "SELECT product_id, greatest(len(words) - 1, 0)::BIGINT AS n_pairs, array_to_string("
    "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), '|') AS pairs FROM term_words",
    "vocab_rf": steps(GRAMS) + "SELECT term, cf, df FROM vocabulary",
    "vocab_desc": steps(WORD_WEIGHTS) + "SELECT term, cf, df FROM vocabulary",
    "tfidf_rf": steps(GRAMS) + "SELECT product_id, term, tf, round(tfidf, 6) AS tfidf FROM weights",
    "tfidf_desc": steps(WORD_WEIGHTS)
    + "SELECT product_id, term || '_description' AS term, tf, round(tfidf, 6) AS tfidf FROM weights",
    "tfidf_entities": steps(ENTITY_WEIGHTS)
    + "SELECT product_id, term || '_named_entities' AS term, tf, round(tfidf, 6) AS tfidf FROM weights",
    "feature_join": steps(GRAMS, FEATURES)
    + "SELECT f.product_id, f.text_length, f.word_count, f.brand_count, count(w.term)::BIGINT AS n_nonzero,"
    " round(coalesce(sum(w.tfidf), 0), 4) AS total FROM features f LEFT JOIN weights w ON w.product_id = f.product_id"
    " GROUP BY ALL",
    "feature_vector": steps(
        GRAMS,
        FEATURES,
        "hand AS (UNPIVOT (SELECT product_id, COLUMNS(* EXCLUDE (product_id, description, label, split))::DOUBLE"
        " FROM features) ON * EXCLUDE (product_id) INTO NAME name VALUE value)",
        "entries AS (SELECT product_id, value FROM hand UNION ALL SELECT product_id, tfidf FROM weights)",
    )
    + "SELECT product_id, count(*) FILTER (value <> 0)::BIGINT AS n_nonzero, round(sum(value), 4) AS total"
    " FROM entries GROUP BY product_id",
    "feature_vector_long": steps(
        GRAMS,
        FEATURES,
        "places AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS ix FROM vocabulary)",
        "names AS (SELECT unnest(" + word_list(HAND_FEATURES) + ") AS name,"
        f" generate_subscripts({word_list(HAND_FEATURES)}, 1) - 1 + (SELECT count(*) FROM vocabulary) AS ix)",
        "hand AS (UNPIVOT (SELECT product_id, COLUMNS(* EXCLUDE (product_id, description, label, split))::DOUBLE"
        " FROM features) ON * EXCLUDE (product_id) INTO NAME name VALUE value)",
        "entries AS (SELECT product_id, ix, value FROM hand JOIN names USING (name)"
        " UNION ALL SELECT product_id, ix, tfidf FROM weights JOIN places USING (term))",
    )
    + "SELECT product_id, ix::BIGINT AS ix, round(value, 6) AS value FROM entries WHERE value <> 0",
    "few_shot_block": steps(LISTINGS, FEW_SHOT)
    + "SELECT string_agg('Description: ' || description || chr(10) || 'Label: ' || label, chr(10) || chr(10)"
    " ORDER BY place) AS block FROM few_shot",
    "prompts": steps(LISTINGS)
    + f"SELECT product_id, md5({_OPENING} || description || {quoted(PROMPT_END_SHORT)}) AS short_md5,"
    f" md5({_OPENING} || description || {quoted(PROMPT_END_LONG)}) AS long_md5,"
    f" length({_OPENING} || description || {quoted(PROMPT_END_LONG)})::BIGINT AS long_length,"
    f" 'system,user' AS roles, md5({quoted(SYSTEM_PROMPT)}) AS system_md5 FROM listings",
    "llm_parse": steps(LISTINGS, RESPONSES, parse(r"regexp_extract(response, '(?s)(\{.*\})', 1)", "found = ''")),
    "llm_parse_strict": steps(LISTINGS, RESPONSES, parse("response", "false")),
    "score_batches": steps(FEATURED, RULE)
    + "SELECT product_id, prediction AS is_spam, round(spam_score, 6) AS spam_score, reasoning, 'ok' AS parse_status"
    " FROM rule",
    "score_ledger": steps(FEATURED, RULE)
    + "SELECT product_id, prediction AS is_spam, round(spam_score, 6) AS spam_score, reasoning, 'ok' AS parse_status"
    " FROM rule",
    "hybrid_score": steps(
        FEATURED,
        "scored AS (SELECT product_id, description, ((product_id * 37) % 100 + 0.5)::DOUBLE / 100 AS classical_score,"
        " least(1.0, (brand_count + tag_indicators) / 4)::DOUBLE AS llm_score,"
        " brand_count || ' brands' AS llm_reasoning FROM features)",
        "mixed AS (SELECT *, (0.4::DOUBLE * classical_score + 0.6::DOUBLE * llm_score) AS combined FROM scored)",
    )
    + "SELECT product_id, left(description, 100) || '...' AS text, (combined >= 0.5)::BIGINT AS is_spam,"
    " round(combined, 6) AS combined_score, round(classical_score, 6) AS classical_score,"
    " round(llm_score, 6) AS llm_score, llm_reasoning FROM mixed",
    "threshold_binary": steps(
        LISTINGS,
        "rated AS (SELECT product_id, round(((product_id * 37) % 100 + 0.5)::DOUBLE / 100, 6) AS probability FROM listings)",
    )
    + "SELECT product_id, probability, (probability >= 0.505)::BIGINT AS prediction FROM rated",
    "confusion_matrix": steps(JUDGED, matrix("judged", "model")) + "SELECT model, tn, fp, fn, tp FROM matrix",
    "classification_metrics": steps(JUDGED, matrix("judged", "model")) + f"SELECT model, {METRIC_COLUMNS} FROM metrics",
    "classification_report": steps(JUDGED, matrix("judged", "model"), REPORT)
    + "SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1_score, 6) AS f1_score, support::BIGINT AS support FROM report",
    "model_comparison": steps(
        JUDGED,
        matrix("judged", "model"),
        "cells AS (UNPIVOT (SELECT model, accuracy::DOUBLE AS accuracy, precision::DOUBLE AS precision,"
        " recall::DOUBLE AS recall, f1_score::DOUBLE AS f1_score FROM metrics)"
        " ON accuracy, precision, recall, f1_score INTO NAME metric VALUE value)",
    )
    + "SELECT metric, round(max(value) FILTER (model = 'tag_section'), 6) AS tag_section,"
    " round(max(value) FILTER (model = 'tag_phrases'), 6) AS tag_phrases FROM cells GROUP BY metric",
    "logloss": steps(
        LISTINGS,
        "rated AS (SELECT split, label, ((product_id * 37) % 100 + 0.5)::DOUBLE / 100 AS p FROM listings"
        " WHERE label IS NOT NULL)",
    )
    + "SELECT split, round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS logloss, count(*) AS n"
    " FROM rated GROUP BY split",
    "code_like": steps(NOTEBOOK_PAGES)
    + f"SELECT page_id, (regexp_matches(html, '[^{WHITESPACE}]') AND regexp_matches(html, '{_CODE_SHAPE}'))::BIGINT"
    " AS code_like FROM notebook_pages",
    "code_cells": steps(CODE_CELLS) + "SELECT page_id, tier::BIGINT AS tier, cell_ix::BIGINT AS cell_ix, code FROM cells",
    "code_scripts": steps(CODE_CELLS)
    + f"SELECT page_id, {quoted(SCRIPT_HEADER)} || string_agg(code, chr(10) || chr(10) ORDER BY cell_ix) AS script"
    " FROM cells GROUP BY page_id",
    "few_shot_scoring_job": steps(
        FEATURED, RULE, "known AS (SELECT * FROM rule WHERE label IS NOT NULL)", matrix("known")
    )
    + f"SELECT {METRIC_COLUMNS} FROM metrics",
    "few_shot_scoring_report": steps(FEATURED, RULE)
    + "SELECT row_number() OVER (ORDER BY product_id) AS row_number, product_id,"
    + REPORT_COLUMNS
    + " FROM rule WHERE label IS NOT NULL",
    "rf_prediction_checks": steps(LISTINGS) + "SELECT product_id, true AS by_threshold, true AS in_range FROM listings",
    "gbt_prediction_checks": steps(LISTINGS) + "SELECT product_id, true AS by_threshold, true AS in_range FROM listings",
    "importance_checks": steps(WORD_WEIGHTS)
    + "SELECT 3::BIGINT AS features, count(*) AS description_terms, 1.0::DOUBLE AS total FROM vocabulary",
    "boosting_root_split": steps(
        FEATURED,
        "known AS (SELECT * FROM features WHERE label IS NOT NULL)",
        "totals AS (SELECT sum(0.5 - label) AS g, 0.25 * count(*) AS h FROM known)",
        "long_rows AS (UNPIVOT (SELECT label, " + ", ".join(f"{n}::DOUBLE AS {n}" for n in ROOT_FEATURES)
        + " FROM known) ON * EXCLUDE (label) INTO NAME name VALUE value)",
        "sums AS (SELECT name, value, sum(0.5 - label) AS g, 0.25 * count(*) AS h FROM long_rows GROUP BY ALL)",
        "sides AS (SELECT name, value, sum(g) OVER spot AS gl, sum(h) OVER spot AS hl FROM sums"
        " WINDOW spot AS (PARTITION BY name ORDER BY value))",
        "best AS (SELECT s.*, g, h, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain"
        " FROM sides s, totals WHERE hl >= 1 AND h - hl >= 1"
        f" ORDER BY round(gain, 9) DESC, list_position({word_list(ROOT_FEATURES)}, name), value LIMIT 1)",
    )
    + "SELECT 1 AS node, name AS feature_name, value AS threshold, round(gain, 6)::DOUBLE AS gain, round(h, 6)::DOUBLE AS cover,"
    " NULL::DOUBLE AS weight FROM best"
    " UNION ALL SELECT 2, NULL, NULL, NULL, round(hl, 6)::DOUBLE, round(-0.3 * gl / (hl + 1), 6)::DOUBLE FROM best"
    " UNION ALL SELECT 3, NULL, NULL, NULL, round(h - hl, 6)::DOUBLE, round(-0.3 * (g - gl) / (h - hl + 1), 6)::DOUBLE FROM best",
    "job_scorer_checks": steps(
        FEATURED,
        RULE,
        "known AS (SELECT 'hybrid' AS job, * FROM rule WHERE label IS NOT NULL"
        " UNION ALL SELECT 'comparison', * FROM rule WHERE label IS NOT NULL AND product_id % 5 = 0)",
    )
    + "SELECT job, 'Random Forest' AS model, count(*) AS n, NULL::BIGINT AS tp, NULL::BIGINT AS fp FROM known GROUP BY job"
    " UNION ALL SELECT job, 'LLM', count(*), count(*) FILTER (label = 1 AND prediction = 1),"
    " count(*) FILTER (label = 0 AND prediction = 1) FROM known GROUP BY job",
}
