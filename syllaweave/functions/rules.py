"""Fixed values of the course domain: they must equal those that published results rest on."""

from __future__ import annotations

# ---- fixed values, in their natural order -------------------------------------------------------------------------
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
#: (pattern over the trimmed lower-case folder name, programme); the first match wins, else OTHER.
PROGRAMMES = [
    (r"intelligence\s*&\s*data", "AI-DS"),
    (r"intelligence\s*&\s*machine", "AI-ML"),
    (r"artifi?ci?al intelligence", "AI"),
    (r"cs\s*-?\s*eds|csds|cse[\s-]*data science", "CSE-DS"),
    (r"cyber", "CSE-CYBER"),
    (r"csbs|business systems", "CSBS"),
    (r"data science", "DS"),
    (r"^computer$", "COMP"),
    (r"^i\s?t$", "IT"),
    (r"extc", "EXTC"),
    (r"electronic", "ELECTRONICS"),
    (r"ele?c?trical", "ELECTRICAL"),
    (r"mechatr|mechator", "MECHATRONICS"),
    (r"mechanical", "MECHANICAL"),
    (r"civil", "CIVIL"),
    (r"^ibm$", "IBM"),
    (r"open elective", "OPEN"),
    (r"common|all stream|semester|trim|management", "COMMON"),
]
ALL_PROGRAMMES = r"all\s+program|all\s+branch|all\s+stream"
POOLS = ["COMMON", "OPEN", "OTHER"]
BLOOM_NAMES = {1: "Remember", 2: "Understand", 3: "Apply", 4: "Analyze", 5: "Evaluate", 6: "Create"}
BLOOM_VERBS = {
    1: "define list recall recognize recognise name state label memorize repeat retrieve enumerate cite reproduce know mention recite tell identify",
    2: "explain describe summarize summarise discuss interpret classify illustrate paraphrase understand comprehend distinguish outline review translate express relate convert compare",
    3: "apply use implement solve execute demonstrate compute calculate operate perform employ utilize utilise practice show simulate install configure write draw sketch program select measure",
    4: "analyze analyse examine contrast categorize categorise investigate deduce infer diagnose experiment organize organise survey decompose debug troubleshoot differentiate test model",
    5: "evaluate assess justify critique judge defend recommend appraise validate verify argue support prioritize prioritise rate optimize optimise conclude decide select",
    6: "design develop create formulate construct build compose devise plan propose synthesize synthesise invent generate integrate assemble architect engineer author produce",
}
SKIP_WORDS = "to be able will would can could students student the a an and or of in on for with also should"
NONE_PREREQUISITE = r"(?i)^\W*(nil|na|n/?a|none|not applicable|no prerequisites?|-+)\W*$"
LEAD_IN = (
    r"(?i)^(?:(?:basic|fundamental|elementary|working|good|sound|prior|general|introductory)\s+)*"
    r"(?:knowledge|understanding|concepts?|familiarity|awareness|proficiency|grasp|idea|basics|fundamentals|principles)"
    r"(?:\s+(?:of|in|about|with|on))?\s+|^(?:basics|fundamentals|introduction)\s+(?:of|to)\s+"
)
NON_SUBJECT = (
    r"(?i)\b(?:subjects?|courses?)\b.*\b(?:till|up ?to|completed|studied|previous|earlier)\b|^\s*all\b|"
    r"\busage\b|\bskills?\b|\baptitude\b|\binterest\b|\bgeography\b|\bschool\b|\bhsc\b|\b10\s*\+\s*2\b"
)
GENERIC_NAME_WORDS = (
    "engineering basic basics introduction introductory fundamental fundamentals principles applied advanced theory elementary "
    "concepts concept knowledge course courses of in and the to for with a an i ii iii iv v vi"
)
UMBRELLA = {
    "mathematics": "mathematics calculus algebra differential equations statistics probability numerical transforms discrete",
    "maths": "mathematics calculus algebra differential equations",
    "programming": "programming python java c coding",
    "algorithms": "algorithms algorithm",
    "electronics": "electronics electronic",
}
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"
JOB_HEADER = r"(?i)^(?:role|responsibilities|requirements|synthetic sample|about|location|salary)\b"
# second rule set of prerequisite phrases
PREREQUISITE_BRACKETS = r"\([^)]*\)?"
PREREQUISITE_CODE = r"\b(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{6,}\b"
PART_NUMBERS = r"(?i)^(?:[IVX]+|\d)(?:\s*(?:and|&|,)?\s*(?:[IVX]+|\d))*$"
PART_NUMBER = r"(?i)[IVX]+|\d"
PART_NUMBER_AT_END = r"(?i)[\s\-–]*(?:[IVX]+|\d)$"
# booklets: lines that belong to no course, running footers, years, Bloom tags, headings
PAGE_NOISE = (
    r"(?i)SVKM|Narsee Monjee|Mukesh Patel School|Prepared by|Approved by|Head of the Dep|^\s*Signature|^_{3,}|^\s*Page \d+|"
    r"Technology Management Department|^\s*A\.?\s?Y\.?\s*20\d\d|^\s*\((?:Dean|Chairperson|Program Chairperson|Head of Department|HOD)[^)]*\)\s*$|^\s*w\.e\.f\.?"
)
PAGE_FOOTER = (
    r"(?i)(?:MBA\s*\(?\s*Tech\)?|B\.?\s?Tech\.?)[^\n]{0,80}?(?:page|pg)\s*[|:.]?\s*\d+"
    r"|[A-Za-z&. ]{5,50}\(\s*20\d\d\s*[-–]\s*20\d\d\s*\)"
    r"|B\.?\s?TECH[/A-Z .()]*/\d{4}[-–]\d{2}/SEM\s*[IVX]+/\d+"
    r"|MPSTME-[A-Z]+-\d+[^\n]{0,15}"
    r"|B\.?\s?Tech\.?[^\n]{0,60}?/\s*(?:Semester|SEM)[-\s]*[IVX]+(?:\s*(?:and|&|/)\s*[IVX]+)?(?:\s*/?\s*(?:A\.?Y\.?[-\s]*)?20\d\d[-–]\d\d\s*/?)?(?:\s*Page\s*\d*)?"
    r"|(?:Electronics\s*(?:&|&amp;|and)\s*Telecommunication|Information Technology|Computer Engineering|Mechanical Engineering|Civil Engineering|Electrical Engineering)\s+Department|_{3,}|\s+of\s+\d{1,3}\s*$"
    r"|(?:\bof\s+\d+|20\d\d\s*[-–]\s*\d\d)\s*/\s*Page\s*\d*|\bA\.?Y\.?[-\s]*20\d\d[-–]\d\d|(?<=[\w.,;])\s*/\s*Page\s*\d+(?:\s*of\s*\d+)?"
)
YEAR_IN_TEXT = r"(20\d\d)\s*[-–/_]\s*(?:20)?(\d\d)\b"
LEVEL_TAG = r"(?i)\(\s*([KL]\s?[1-6](?:\s*[,&/]\s*[KL]?\s?[1-6])*)(?:\s*[-–:]\s*[A-Za-z]+)?\s*\)"
HEADINGS = {
    "objectives": r"(?:course\s+)?objectives?",
    "outcomes": r"(?:course\s+|learning\s+)?outcomes?",
    "syllabus": r"detailed\s+syllabus.*",
    "experiments": r"list\s+of\s+(?:experiments|practicals?|laboratory\s+experiments?)",
    "books": r"(?:prescribed\s+)?text\s?books?(?:\s+and\s+reference\s+books?)?",
    "refs": r"reference\s+books?|references?",
    "lab": r"laboratory\s*/?\s*(?:tutorial\s+)?work|tutorial\s+work",
    "stop": r"any\s+other\s+information|internet\s+references?|nptel.*|online\s+(?:resources|courses?).*|e-?resources.*|term\s*work\b.*|"
    r"details?\s+of\s+(?:test|term).*|total\s+marks.*|distribution\s+of\s+ica.*|in\s+order\s+to\s+complete.*|internal\s+continuous\s+assessment.*|note\s*:.*",
}
HEADER = {
    "program": r"(?is)program(?:me)?\s*[:\-–]?\s*(.*?)\n\s*semester",
    "semester": r"(?i)semester\s*[:\-–]?[ \t]*([^\n]*(?:\n\s*[/&,][^\n]*)?)",
    "name": r"(?is)\n\s*course(?:\s*/\s*module|\s+name|\s+title)?\s*[:\-–]?\s*(?!objectives?|outcomes?)(\S.*?)(?=\n\s*(?:module\s+|course\s+)?code|\n\s*teaching)",
    "code": r"(?i)(?:module\s+|course\s+)?code[ \t]*[:\-–]?[ \t]*((?:[A-Z0-9][ \t]?){6,14})",
    "scheme": r"(?s)(\d)\s*\n\s*(\d)\s*\n\s*(\d)\s*\n\s*(\d{1,2})\s*\n\s*(?:Marks|-|\d)",
    "prerequisites": r"(?is)pre\s*[-–]?\s*requisites?[ \t]*[:\-–]?[ \t]*(.*?)(?=\n\s*(?:course\s+)?objectives?|\n\s*(?:course\s+)?outcomes?)",
}
SEMESTER_REST = r"(?i)[^IVX0-9/&,\- to]|^\W+"
ELECTIVE = r"(?i)^(?:professional|open|department(?:al)?|dept\.?|institute|program(?:me)?)?\s*elective(?:\s+course)?\s*[-–]?\s*[0-9IVX]*\s*\((.+)\)\s*(?:\(\s*\))?$"
NAME_CODE = r"(?is)\s+(?:module\s+|course\s+)?code\s*[:\-–].*$"
NAME_REMARK = r"(?i)\(\s*(?:[^)]*(?:elective|technical pool)[^)]*)?\)"
UNIT_TABLE_END = r"(?im)^\s*total\b"
UNIT_COLUMN_NAMES = r"(?i)^(unit|description|duration|topics?|hrs?\.?|hours?|no\.?)(\s+(description|duration|hrs?\.?|hours?))*\s*$"
UNIT_NUMBER_ALONE = r"(?m)^(\d{1,2})[ \t]*[.)]?[ \t]*(?:\n|$)"
UNIT_NUMBER_LEADING = r"(?m)^(\d{1,2})(?:\s*[.)]\s*(?=\S)|\s+(?=[A-Z]))"
UNIT_NUMBER_WITHIN = r"(?<=[.;])[ \t]+(\d{1,2})[.)][ \t]+(?=[A-Z])"
UNIT_HOURS = r"(?m)^[ \t]*(\d{1,2})[ \t]*$|^(.*?)(?<![\w.,/()-])0([1-9])(?![\w.,%/()-])"
UNIT_TITLE_LINE = r"(?<![,;-])\n[A-Z\"(‘']"
OUTCOME_END = r"(?im)^\s*(?:unit\s+description|syllabus\b)"
OUTCOME_STEM = r"(?is)^\s*(?:after|upon|on|at the end|by the end|the students?|students?)\b[^:\n]{0,140}?\b(?:able to|will be|would be|following)\b[^\n:]*[:\-–]?[ \t]*"
OUTCOME_NUMBER = r"(?m)^\s*(?:CO\s?)?\d{1,2}\s*[.):]\s*"
OUTCOME_NUMBER_WITHIN = r"(?:(?<=[\s,;.])|^)(\d{1,2})[.)]?\s+(?=[A-Z][a-z]+)"
OUTCOME_UNFINISHED = (
    r"(?i)^(?:after|upon|on|at the end|by the end|the student|students?)\b.*\b(?:able to|will be|would be|following)\W*$"
    r"|\b(?:able to|learn to|will be|would be|the following|is to)\W*$"
)
OUTCOME_VERBS = (
    "define list recall recognize recognise name state label memorize repeat retrieve enumerate identify explain describe summarize "
    "summarise discuss interpret classify illustrate paraphrase understand comprehend distinguish outline review translate express relate convert "
    "compare apply use implement solve execute demonstrate compute calculate operate perform employ utilize utilise practice show simulate install "
    "configure write draw sketch program select measure analyze analyse examine contrast categorize categorise investigate deduce infer diagnose "
    "experiment organize organise survey decompose debug troubleshoot differentiate test model evaluate assess justify critique judge defend "
    "recommend appraise validate verify argue support prioritize optimize conclude decide design develop create formulate construct build compose "
    "devise plan propose synthesize synthesise invent generate integrate assemble produce work communicate function handle choose "
    "make prepare determine estimate predict acquire gain learn effectively"
)
BULLET_GLYPHS = "[●•▪◦]"
MIN_YEAR = 2020
COMPUTING = r"(?i)comput|information technology|artificial|data scien|cyber|\bIT\b|\bAI\b|\bDS\b|CSBS|CSE|\bCE\b"
# web pages: sections with content and without, course numbers, cells that name no topic
KEEP_SECTION = r"prereq|descr|overview|content|topic|outline|objective|goal|outcome|purpose|about|learn|scope|introduction"
DROP_SECTION = (
    r"meeting|grad|exam|quiz|problem set|homework|assignment|polic|collaborat|honest|integrity|attend|late|"
    r"text|book|reading|software|staff|lecturer|instructor|team|evaluat|requirement|recitation|format|"
    r"participat|laptop|matlab|makeup|extension|habit|reference|project|calendar|video|tutorial|office|contact"
)
OUTCOME_SECTION = r"objective|goal|outcome|purpose|learn"
COURSE_REFERENCE = r"\b(?:\d{1,2}[A-Z]?|[A-Z]{2,4})\.[S\d]\d{1,3}[A-Z]{0,2}\b"
NOISE_CELL = r"(?i)^(no (class|lecture)|holiday|.*\b(quiz|exam|midterm|review session|due|out)\b.*|student holiday.*)$"
# topic lexicon: a topic and the words that name it
TOPIC_LEXICON = {
    "Probability": r"probabilit(y|ies)|random variables?",
    "Statistical Inference": r"statistical inference|estimat(ion|ors?)|maximum likelihood|confidence intervals?",
    "Hypothesis Testing": r"hypothesis test\w*|p-values?|significance tests?",
    "Bayesian Methods": r"bayes(ian)?",
    "Regression": r"regression",
    "Classification": r"classif(ication|iers?)",
    "Clustering": r"cluster(ing|s)?|k-means",
    "Dimensionality Reduction": r"dimensionality reduction|principal component|\bpca\b|singular value|\bsvd\b",
    "Neural Networks": r"neural net(work)?s?|perceptrons?|backprop\w*",
    "Deep Learning": r"deep learning|convolutional|\bcnns?\b|recurrent|\brnns?\b|\blstms?\b",
    "Transformers & LLMs": r"transformers?|attention mechanisms?|large language models?|\bllms?\b|\bgpt\b|\bbert\b",
    "Generative Models": r"generative (models?|adversarial)|\bgans?\b|variational autoencoders?|diffusion models?",
    "Natural Language Processing": r"natural language|\bnlp\b|parsing|language model(s|ing)?|machine translation",
    "Computer Vision": r"computer vision|machine vision|image (processing|recognition)|object recognition",
    "Reinforcement Learning": r"reinforcement learning|markov decision|\bmdps?\b|q-learning|policy gradient",
    "Kernel Methods & SVM": r"kernels?|support vector",
    "Ensemble & Tree Methods": r"boosting|bagging|random forests?|decision trees?|ensembles?",
    "Learning Theory": r"learning theory|generalization|vc[- ]dimension|\bpac\b|rademacher",
    "Graphical Models": r"graphical models?|bayesian networks?|markov random fields?|belief propagation|sum-product",
    "Hidden Markov Models": r"hidden markov|\bhmms?\b",
    "Markov Chains & Stochastic Processes": r"markov chains?|stochastic process(es)?|random walks?|poisson process\w*",
    "Monte Carlo & Simulation": r"monte carlo|simulations?|\bmcmc\b",
    "Linear Algebra": r"linear algebra|matri(x|ces)|eigen\w*|vector spaces?",
    "Calculus & Differential Equations": r"calculus|differential equations?",
    "Optimization": r"optimi[sz]ation|gradient descent|convex|linear programming|lagrang\w*",
    "Numerical Methods": r"numerical (methods?|analysis|linear algebra)|finite differences?|iterative methods?",
    "Algorithms & Complexity": r"algorithms?|np-complete\w*|asymptotic|complexity",
    "Data Structures": r"data structures?|hash(ing| tables?)|heaps?|binary search trees?",
    "Graph Algorithms": r"graph algorithms?|shortest paths?|minimum spanning|network flows?|max(imum)?[- ]flow",
    "Dynamic Programming": r"dynamic programming",
    "Discrete Mathematics": r"combinatori\w*|discrete mathematics|graph theory",
    "Information Theory": r"information theory|entropy|mutual information",
    "Signal Processing": r"signal processing|fourier|z-transforms?|sampling theorem|digital filters?",
    "Time Series": r"time series|autoregressive|\barima?\b|forecasting",
    "Econometrics & Causal Inference": r"econometric\w*|instrumental variables?|panel data|causal|treatment effects?",
    "Data Analysis & Analytics": r"data mining|analytics|data analysis|data science",
    "Search & Planning": r"search algorithms?|heuristic search|planning|constraint satisfaction",
    "Logic & Knowledge Representation": r"propositional logic|first-order logic|knowledge representation",
    "Robotics & Control": r"robot\w*|control systems?|feedback control|motion planning",
    "Game Theory": r"game theory|nash equilibri\w*",
    "Distributed & Parallel Computing": r"distributed (algorithms?|systems?|computing)|parallel (computing|algorithms?)",
    "Databases": r"databases?|\bsql\b",
    "Finance": r"financ\w*|portfolios?|asset pricing|option pricing",
    "Healthcare": r"health ?care|clinical|medical",
    "Ethics & Fairness": r"ethic\w*|fairness",
    "Programming Tools (Python/R/Julia/MATLAB)": r"python|julia|matlab|\br\b (programming|language|software)",
}
FUSION_K, BM25_K1, BM25_B, BM25_EPSILON = 60, 1.5, 0.75, 0.25
MIN_VERSIONS, MIN_FAMILIES_PER_SEM = 50, 3
SPLIT_SHARES = {"train": 0.6, "val": 0.2, "test": 0.2}
# -------------------------------------------------------------------------------------------------------------------

#: A verb listed at several levels keeps its lowest.
VERB_LEVEL: dict[str, int] = {}
for _level, _verbs in BLOOM_VERBS.items():
    for _verb in _verbs.split():
        VERB_LEVEL.setdefault(_verb, _level)
