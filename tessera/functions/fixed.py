"""Word lists, patterns and tables that decide results."""

# --- Fixed values: method terms (regular expressions, matched between word boundaries, any case) ---
METHOD_TERMS = (
    r"artificial\s+intelligence", r"explainable\s+ai", r"generative\s+ai", r"machine\s+learning", r"deep\s+learning", r"reinforcement\s+learning",
    r"transfer\s+learning", r"supervised\s+learning", r"unsupervised\s+learning", r"semi-?supervised\s+learning", r"self-?supervised",
    r"few-?shot\s+learning", r"zero-?shot", r"neural\s+network", r"artificial\s+neural", r"deep\s+neural", r"convolutional", r"recurrent\s+neural",
    r"multilayer\s+perceptron", r"back-?propagation", r"autoencoder", r"vision\s+transformer",
    r"transformer\s+(?:model|models|architecture|network|encoder|decoder)", r"large\s+language\s+models?", r"language\s+models?",
    r"natural\s+language\s+processing", r"named\s+entity", r"sentiment\s+analysis", r"question\s+answering", r"text\s+classification",
    r"topic\s+model(?:ing)?", r"latent\s+dirichlet", r"word2vec", r"word\s+embedding", r"computer\s+vision", r"object\s+detection",
    r"image\s+segmentation", r"semantic\s+segmentation", r"instance\s+segmentation", r"image\s+classification", r"face\s+recognition",
    r"speech\s+recognition", r"generative\s+adversarial", r"support\s+vector\s+machine", r"random\s+forest", r"gradient\s+boosting",
    r"decision\s+tree", r"k-?nearest\s+neighbou?rs", r"k-?means", r"genetic\s+algorithm", r"particle\s+swarm", r"swarm\s+intelligence",
    r"expert\s+system", r"fuzzy\s+(?:logic|inference)", r"multi-?agent", r"intelligent\s+agent", r"knowledge[- ]based\s+system", r"pytorch",
    r"tensorflow", r"scikit-?learn", r"hugging\s?face", r"bertopic", r"chatgpt", r"gpt-[234]", r"llama\s?\d", r"yolov?\d", r"resnet", r"densenet",
    r"efficientnet", r"vgg-?\d", r"unet", r"u-net", r"xgboost", r"lightgbm", r"catboost", r"keras", r"cnn", r"rnn", r"lstm", r"gru", r"nlp", r"llm",
    r"gans?", r"svm", r"bert", r"xai", r"mlp", r"dnn",
)
METHOD_PREFIXES = ("ai-based", "ai-driven", "ai-powered", "ai-assisted", "ai-enabled")

# --- Fixed values: affiliation keywords of the home country ---
HOME_KEYWORDS = (
    "nepal", "tribhuvan university", "kathmandu university", "pokhara university", "purbanchal university", "mid-western university",
    "mid western university nepal", "far-western university", "far western university", "nepal open university", "lumbini buddhist university",
    "gandaki university", "madan bhandari university", "rajarshi janak university", "institute of engineering, pulchowk",
    "institute of engineering, nepal", "ioe pulchowk", "pulchowk campus", "thapathali campus", "purwanchal campus", "paschimanchal campus",
    "western regional campus, pokhara", "naamii", "nepal applied mathematics and informatics institute",
    "nepal academy of science and technology", "nepal agricultural research council", "nast nepal", "softwarica college", "islington college",
    "herald college kathmandu", "the british college", "lord buddha education foundation", "kathmandu engineering college",
    "nepal college of information technology", "ncit nepal", "khwopa college", "kantipur engineering college", "himalaya college of engineering",
    "advanced college of engineering and management", "deerwalk", "nepal engineering college", "samriddhi college",
)
HOME_CITIES = (
    "kathmandu, nepal", "lalitpur, nepal", "pokhara, nepal", "biratnagar, nepal", "dharan, nepal", "bharatpur, nepal", "khumaltar, nepal",
    "dhulikhel, nepal",
)
HOME_GENERIC = ("institute of engineering", "agriculture and forestry university")
HOME_CONTEXT = ("nepal", "pulchowk", "tribhuvan", "kathmandu", "lalitpur", "pokhara", "dhulikhel", "khumaltar", "chitwan", "rampur")
HOME_CODE = "NP"

# --- Fixed values: acronyms that tokenising keeps ---
PROTECTED = (
    "ai", "ml", "dl", "nlp", "cv", "rl", "llm", "cnn", "rnn", "lstm", "gru", "gan", "gans", "svm", "knn", "bert", "gpt", "xai", "mlp", "dnn", "ann",
    "nn", "iot", "gis", "ocr", "asr", "tts", "vae", "rag",
)

# --- Fixed values: stop words of the domain ---
DOMAIN_STOPWORDS = (
    "paper", "study", "research", "propose", "proposed", "result", "results", "method", "methods", "approach", "using", "use", "used", "based",
    "show", "shows", "shown", "also", "however", "therefore", "thus", "abstract", "article", "author", "authors", "journal", "conference",
    "respectively", "et_al", "challenge", "enhance", "include", "improve", "provide", "develop", "find", "identify", "evaluate", "high", "achieve",
    "potential", "make", "different", "present", "compare", "comparison", "demonstrate", "various", "advance", "integrate", "aim", "significant",
    "increase", "focus", "address", "need", "future", "explore", "work", "due", "highlight", "offer", "reduce", "effective", "among", "well",
    "enable", "across", "apply", "key", "better", "perform", "help", "support", "efficient", "examine", "new", "case", "conduct", "contribute",
    "require", "best", "current", "indicate", "within", "novel", "suggest", "obtain", "investigate", "specific", "important", "major", "consider",
    "type", "number", "additionally", "several", "many", "recent", "overall", "reveal", "total", "report", "furthermore", "allow", "large",
)

#: Everyday English words of our own choice.
ENGLISH_STOPWORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor "
    "not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your".split()
)

# --- Fixed values: headers that publishers put into abstracts ---
SECTION_HEADERS = (
    "background", "objectives?", "methods?", "materials and methods", "results?", "conclusions?", "findings", "purpose", "aim", "introduction",
    "discussion",
)

# --- Fixed values: patterns of the text cleaner; tails reach the end of the text, and none fires if a line break follows ---
COPYRIGHT = r"(?i)(©\s*\d{4}.*$|copyright\s+\d{4}.*$|all rights reserved.*$|this article is licensed under.*$|creative commons.*$)"
URL, DOI, EMAIL = r"(?i)https?://\S+|www\.\S+", r"(?i)\b(?:doi:\s*)?10\.\d{4,9}/\S+", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"
LEADING = r"(?i)^\s*abstract\b[\s:.–—-]*"
ACRONYM = r"\(\s*[A-Z][A-Za-z]{1,7}s?\s*\)"
ABBREVIATION = r"(?<![A-Za-z])(?:AI|ML)(?![A-Za-z])"

# --- Fixed values: patterns of the corpus report, which differ from the cleaner's ---
PREPRINT_VENUE = r"(?i)\b(arxiv|ssrn|zenodo|research\s?square|preprints?\.org|biorxiv|medrxiv|techrxiv|osf\b|authorea|figshare|hal\b)"
REPORT_LEADING = r"(?i)^\s*abstract\b[:.\s-]*"
REPORT_COPYRIGHT = r"(?i)(all rights reserved|©\s?\d{4}|copyright\s+\d{4})"

# --- Fixed values: terms and institutions that scans ask for ---
QUERY_TERMS = (
    "artificial intelligence", "machine learning", "deep learning", "neural network", "natural language processing", "computer vision", "generative AI",
    "large language model", "reinforcement learning",
)
QUERY_INSTITUTIONS = (
    "Tribhuvan University", "Kathmandu University", "Pokhara University", "Purbanchal University", "Pulchowk", "NAAMII", "Softwarica College",
    "Lord Buddha Education Foundation", "Herald College Kathmandu", "Nepal Academy of Science", "Kathmandu Engineering College",
)

# --- Fixed values: shift vectors of two continuous test functions (first ten dimensions) ---
SHIFT_ROSENBROCK = (81.0232, -48.395, 19.2316, -2.5231, 70.4338, 47.1774, -7.8358, -86.6693, 57.8532, -9.9533)
SHIFT_RASTRIGIN = (1.9005, -1.5644, -0.9788, -2.2536, 2.499, -3.2853, 0.9759, -3.6661, 0.0985, -3.2465)
BIAS_ROSENBROCK, BIAS_RASTRIGIN = 390.0, -330.0

#: Endings of nouns and verbs with what takes their place in a base form.
NOUN_DETACHMENTS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
VERB_DETACHMENTS = (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))
