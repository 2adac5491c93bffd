"""Word lists, patterns, texts and defaults that results depend on.

Nothing here is logic. A different value gives a different result, so the values
are kept together and every operator takes them as overridable parameters.
"""

# --- character classes of Java regex: Unicode white space with the four ASCII
# --- information separators, and letters, numbers and underscore ------------------
WHITESPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"

# --- lexicons of the hand-made features ----------------------------------------
BRANDS = ["nike", "adidas", "gucci", "chanel", "versace", "supreme", "zara", "h&m", "brandy", "melville"]
TAG_PHRASES = ["tag", "tags:", "tags", "tagged", "ignore:", "ignore"]
TAG_SECTION_MARKERS = ["tags:", "ignore:", "~ignore~", "tagged for exposure"]

# --- characters turned into a blank by the notebook cleaning (a blank stays one) --
SEPARATORS = r"[,;@#!?+*\n\-:/]"

# --- words a Treebank tokeniser splits in two -----------------------------------
CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]

# --- English stop words (the common 179-word list) ------------------------------
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't
""".split()

# --- ASCII spellings that do not follow from Unicode decomposition --------------
TRANSLITERATIONS = [
    ("¢", "C/"), ("£", "PS"), ("¥", "Y="), ("§", "SS"), ("©", "(c)"), ("«", "<<"), ("®", "(r)"), ("°", "deg"),
    ("»", ">>"), ("¼", " 1/4 "), ("½", " 1/2 "), ("¾", " 3/4 "), ("Æ", "AE"), ("Þ", "Th"), ("ß", "ss"),
    ("æ", "ae"), ("þ", "th"), ("Œ", "OE"), ("œ", "oe"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("—", "--"), ("…", "..."),
    ("€", "EUR"), ("™", "(tm)"), ("№", "No"), ("‼", "!!"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("Ø", "O"), ("ø", "o"), ("Đ", "D"), ("đ", "d"), ("Ð", "D"), ("ð", "d"), ("Ł", "L"), ("ł", "l"), ("ı", "i"),
    ("×", "x"), ("÷", "/"), ("ª", "a"), ("º", "o"), ("µ", "u"), ("¡", "!"), ("¿", "?"), ("¬", "!"), ("¶", "P"),
    ("·", "*"), ("•", "*"), ("¹", "1"), ("²", "2"), ("³", "3"), ("´", "'"), ("‘", "'"), ("’", "'"), ("‚", ","),
    ("“", '"'), ("”", '"'), ("„", '"'), ("–", "-"), ("‐", "-"), ("‑", "-"), (" ", " "),
]

# --- labels and report format ---------------------------------------------------
SPAM, NOT_SPAM = "Spam", "Not Spam"
PREVIEW_LIMIT, PREVIEW_KEEP, PREVIEW_TAIL = 50, 47, "..."
EXPLANATION_PREVIEW = 100

# --- defaults -------------------------------------------------------------------
THRESHOLD = 0.5
SCORE_BATCH_SIZE = 5
HEAD_ROWS = 20
FEW_SHOT_EXAMPLES = 4
SEED = 42
FOREST_TREES, FOREST_DEPTH = 100, 10
BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP = 2, 6, 0.3
WORD_VOCABULARY, GRAM_VOCABULARY = 500, 5000
GRAM_MIN_DF, GRAM_MAX_DF = 2, 0.8
ENTITY_SUFFIX, DESCRIPTION_SUFFIX = "_named_entities", "_description"
CLASSICAL_WEIGHT, SCORER_WEIGHT = 0.4, 0.6

# --- prompt texts (indentation is part of the text) -----------------------------
SYSTEM_PROMPT = """
        You are an expert at detecting keyword spam in e-commerce product descriptions.
        
        Keyword spamming is when sellers include unrelated, irrelevant keywords in their product descriptions
        to improve their ranking in search results. This creates a poor experience for buyers who see irrelevant
        products in their search results.
        
        Examples of keyword spam:
        1. Adding a list of brand names that aren't related to the actual product
        2. Adding hashtags with irrelevant terms
        3. Including phrases like "ignore:" followed by keywords
        4. Adding a long list of unrelated terms at the end of a description
        
        Your task is to analyze product descriptions and determine if they contain keyword spam.
        Respond with a JSON object containing:
        1. "is_spam": boolean indicating if the description contains keyword spam
        2. "spam_score": a number between 0 and 1 indicating the confidence level
        3. "reasoning": brief explanation of your decision
        """
PROMPT_BEFORE_EXAMPLES = """
                Here are some examples of spam and non-spam product descriptions:
                
                """
PROMPT_BEFORE_TEXT = """
                
                Now, analyze this product description for keyword spam:
                
                Description: """
PROMPT_END_SHORT = """
                """
PROMPT_END_LONG = """
                
                Respond with a JSON object containing:
                1. "is_spam": boolean indicating if the description contains keyword spam
                2. "spam_score": a number between 0 and 1 indicating the confidence level
                3. "reasoning": brief explanation of your decision
                """
EXAMPLE_DESCRIPTION, EXAMPLE_LABEL, EXAMPLE_SEPARATOR = "Description: ", "\nLabel: ", "\n\n"

BUILT_IN_EXAMPLES = [
    (
        "Super cute high waisted blue jeans. recommended for shorter / petite girls, I'm 5'1 and it fits me perfect. These are more of jeggings than jeans and have a polyester material inside. Only flaw: the zipper goes down by itself sometimes. Size 0 / waist 23",
        "Not Spam",
    ),
    (
        "Jordan 5 P51 Camo Size 9 Good condition Soles have yellowing No box or lacelocks $160 Travis Supreme concepts Jordan 1 3 5 6 7 11 12 Nike ovo Kanye yeezy boost 350 shadow royal bred shattered cement top 3 black toe infrared raptor gamma space jam air max vapormax flyknit Travis Scott kaws off white atmos 95 97 98 silver gold bullet protro Kobe fieg kith Levi's undefeated Palace tinker stash SB dunk stone island Foamposite plus Acronym VF Wotherspoon 270 SW LeBron Kyrie Pippen",
        "Spam",
    ),
    ("Denim jacket Never been worn Size XL", "Not Spam"),
    (
        "gorgeous y2k juicy couture velvet zip up. super pretty turquoise color. worn only a few times and in perfect condition. 100% authentic! size medium but would fit a small nicely tags #lingerie #lace #vintagedepop #sofuckingdepop #depopfamous lily rose depp devon lee carlson corset black tank cami 90s 2000s y2k tank top camisole black lace top mock lingerie black v neck lace lined top strappy top carrie bradshaw milkmaid cami crop top blouse v neck lace sex and the city cruel intentions clueless black swan victorias secret cami",
        "Spam",
    ),
]

# --- scorer responses -----------------------------------------------------------
REASON_NO_JSON = "Failed to parse JSON response"
REASON_ERROR = "Error processing with LLM"
SCORE_NO_JSON_SPAM, SCORE_NO_JSON_OTHER = 0.5, 0.0

# --- notebook HTML --------------------------------------------------------------
CELL_CLASSES = ["jp-CodeCell", "code_cell"]
INPUT_CLASSES = ["jp-Cell-inputArea", "input_area"]
HIGHLIGHT_CLASS = "highlight"
SCRIPT_HEADER = '#!/usr/bin/env python3\n"""\nThis script was automatically generated from a Jupyter notebook HTML export\n"""\n\n'
SCRIPT_SEPARATOR = "\n\n"
