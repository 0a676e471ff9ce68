"""Word lists, patterns and constants that results depend on. Patterns are in Python's dialect."""

from __future__ import annotations

THRESHOLD, EMBEDDING_BAR, TOKEN_BAR, MAX_ITERS = 0.30, 0.76, 0.50, 5
LOW_BURSTINESS = 0.35

# Very common words of the lite scorer.
COMMON_WORDS = """the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all
would there their what so up out if about who get which go me when make can like time no just him know take people into year your good some could
them see other than then now look only come its over think also back after use two how our work first well way even new want because any these
give day most us is are was were been has had more very such additionally moreover furthermore however therefore thus overall""".split()

# Vocabulary of the ai_vocab category.
VOCABULARY = """delve leverage utilize utilizing robust seamless seamlessly tapestry testament realm landscape underscore underscores underscoring pivotal
crucial vital foster fostering garner garnered bolster elevate embark harness harnessing unlock unleash spearhead paramount plethora myriad
multifaceted nuanced intricate intricacies meticulous meticulously comprehensive vibrant bustling noteworthy groundbreaking transformative
innovative boasts nestled profound holistic actionable impactful streamline empower empowering revolutionize resonate encompass paradigm
cornerstone burgeoning quintessential overarching synergy endeavor commence illuminate cultivate catalyze galvanize augment elucidate interplay
underpin compelling unprecedented exceptional remarkable sophisticated invaluable unwavering scalable bespoke showcasing showcase reimagine
reimagining world-class cutting-edge state-of-the-art best-in-class top-tier next-level turnkey supercharge unparalleled trailblazing""".split()

# Phrases of formulaic_transition, steering_opener and cliche.
TRANSITIONS = [
    "Moreover", "Furthermore", "Additionally", "Overall", "Ultimately", "Thus", "Therefore", "Accordingly", "Hence", "Subsequently", "Consequently",
    "Nevertheless", "Nonetheless", "Similarly", "Alternatively", "Indeed", "Essentially", "Arguably", "In essence", "That said", "On the other hand",
]
STEERING = ["Interestingly", "Notably", "Importantly", "Surprisingly", "Crucially", "Remarkably"]
CLICHES = [
    r"in today'?s (?:fast-paced|digital|modern|ever-changing) world", r"in the ever-evolving \w+ of", r"in an era where",
    r"as technology continues to evolve", r"when it comes to", r"at its core", r"at the end of the day", r"in the realm of",
    r"this is where \w+ comes in", r"it'?s (?:important|worth) (?:to note|noting)", r"it cannot be overstated", r"one of the most important",
    r"plays? a (?:crucial|pivotal|vital) role", r"stands? as a testament to", r"underscores? the importance of",
    r"reflects? a broader (?:trend|shift)", r"marks? a significant shift", r"let'?s dive in", r"dive into", r"deep dive", r"shed light on",
    r"pave[sd]? the way", r"navigate the complexities of", r"embark on a journey", r"explore the intricacies of", r"in conclusion", r"in summary",
    r"to summarize", r"the future looks bright", r"only time will tell", r"one thing is certain", r"as we move forward",
    r"despite (?:the )?challenges,? \w+ continues to thrive", r"vibrant hub", r"thriving ecosystem", r"rich tapestry of", r"game-?changer",
    r"game-?changing",
]

# What each pattern category counts. OPENER stands for the start of a line or of a sentence.
OPENER = "<opener>"
CATEGORIES = {
    "ai_vocab": r"\b(" + "|".join(VOCABULARY) + r")\b",
    "formulaic_transition": OPENER + "(" + "|".join(TRANSITIONS) + r")\b",
    "steering_opener": OPENER + "(" + "|".join(STEERING) + "),",
    "negated_contrast": r"\b(?:it'?s not\s+\w+[^.,;]{0,40},?\s+it'?s\s+\w+|not only\b[^.]{0,60}\bbut also\b|isn'?t about\b[^.;]{0,50};?\s+it'?s about\b|not\s+just\b[^.]{0,40}\bbut\b)",
    "participial_trailer": r",\s+(?:under(?:scoring|lining)|marking|reflecting|highlighting|showcasing|emphasizing|signaling|cementing|solidifying|paving|ensuring|demonstrating)\b[^.!?]*[.!?]",
    "vague_attribution": r"\b(studies show|research suggests?|experts? (?:believe|say|agree)|scientists? believe|it is (?:widely )?believed|many believe|some argue)\b",
    "cliche": r"\b(" + "|".join(CLICHES) + r")\b",
    "sycophancy": OPENER + r"(Certainly!|Absolutely!|Great question!|Sure,? here'?s|Let me (?:break this down|walk you through)|You'?re absolutely right)",
    "meta_closer": r"\b(I hope this helps|Let me know if|Feel free to reach out|Is there anything else|In this article,? we(?:'ll| will) explore|Here'?s a breakdown)\b",
    "chatbot_artifact": r"(citeturn|oai_citation|utm_source=chatgpt\.com|\[INSERT[^\]]*\]|As an AI language model)",
    "inflated_copula": r"\b(serves as|boasts|epitomizes|exemplifies)\b",
    "hedge_stacking": r"\b(?:could|can|may|might|would|will)\s+(?:potentially|eventually|ultimately|possibly|conceivably|arguably|likely|perhaps)\b",
    "false_range": r"\bwhether you'?re\s+(?:an?\s+)?\w+[^.!?]{0,40}\bor\s+(?:an?\s+)?\w+|\bfrom\s+(?:ancient|the everyday|the mundane|individual|small|humble)\b[^.!?]{0,50}\bto\s+the\b",
    "markdown_artifact": r"^\s*(?:#{1,6}\s*)?(?:key takeaways?|key points?|tl;?dr|in a nutshell)\b|^#{1,6}\s.*[🌀-🫿✅✨]",
}
EVERY_CATEGORY = ["em_dash", *CATEGORIES, "rule_of_three", "semicolon_crutch"]

# What locking protects, in order, and the sentinel's form.
SENTINEL, SENTINEL_FORMAT = r"⟦HZ\d{4,}⟧", "⟦HZ%04d⟧"
LOCKED = {
    "sentinel": SENTINEL,
    "bracket_citation": r"\[\d+(?:\s*[-,]\s*\d+)*\]",
    "author_year": r"\([A-Z][A-Za-z'’.-]+(?:\s+(?:&|and|et al\.?)\s*[A-Za-z'’.-]*)*,?\s*\d{4}[a-z]?(?:,\s*pp?\.?\s*\d+)?\)",
    "narrative_year": r"[A-Z][A-Za-z'’.-]+(?:\s+et al\.?)?\s+\(\d{4}[a-z]?\)",
    "url": r"(?i)https?://\S+|doi:\s*\S+",
    "quote": r"[\"“][^\"”]{1,400}[\"”]",
    "number": r"[$€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*\.\d+\b|\b\d{1,3}(?:,\d{3})+\b|\b\d+\s*(?:%|kg|km|cm|mm|mol|°[CF]?|years?|days?|hours?|minutes?)\b|\b\d{2,}\b",
}

# Invisible carriers, and letters that look like ASCII ones.
INVISIBLE = "\u200b\u200c\u2060\ufeff"
LOOKALIKES, ASCII_LETTERS = "асеорхуАВСЕНКМОРТХ", "aceopxyABCEHKMOPTX"

# Opener phrases and swaps of the scripted rewrite.
DROPPED_OPENERS = ["Moreover", "Furthermore", "Additionally", "Overall", "In conclusion", "In summary", "Notably", "Importantly", "Consequently", "Therefore", "Thus", "Hence"]
SWAPS = {
    "numerous": "many", "significant": "real", "significantly": "sharply", "fundamentally": "deeply", "various": "different", "crucial": "key",
    "essential": "needed", "represents": "is", "enables": "lets", "enabled": "let", "utilize": "use", "utilizing": "using",
    "increasingly": "more and more", "tend to": "often", "in recent years": "lately", "plays a crucial role": "matters",
    "vast amounts of": "huge piles of",
}

# Synonyms of the surgical rewrite.
SYNONYMS = {
    "numerous": ["many", "plenty of", "lots of"], "significant": ["real", "major", "big"], "significantly": ["sharply", "a lot", "hugely"],
    "fundamentally": ["deeply", "at root", "basically"], "various": ["different", "all sorts of", "assorted"],
    "crucial": ["key", "vital", "central"], "essential": ["needed", "key", "necessary"], "utilize": ["use"], "utilizing": ["using"],
    "leverage": ["use", "lean on"], "facilitate": ["help", "ease"], "demonstrate": ["show"], "enhance": ["improve", "boost"],
    "optimize": ["tune", "sharpen"], "robust": ["solid", "sturdy"], "comprehensive": ["full", "thorough"], "innovative": ["new", "fresh"],
    "paradigm": ["model", "pattern"], "myriad": ["countless", "tons of"], "pivotal": ["key", "central"], "seamless": ["smooth"],
    "delve": ["dig", "look"], "realm": ["area", "space"], "furthermore": ["also", "and"], "moreover": ["also", "on top of that"],
    "additionally": ["also", "plus"], "consequently": ["so", "as a result"], "therefore": ["so"], "however": ["but", "though"],
    "overall": ["in the end", "all told"],
}

# Scorers with their tiers, lowest tier first.
TIERS = ["lite", "full", "heavy", "commercial"]
SCORERS = {
    "perplexity_burstiness": "lite", "roberta_openai": "full", "hc3_roberta": "full", "mage": "full", "radar": "full", "fast_detectgpt": "full",
    "binoculars": "heavy", "llm_judge": "commercial", "originality": "commercial", "winston": "commercial", "gptzero": "commercial",
    "sapling": "commercial", "zerogpt": "commercial", "copyleaks": "commercial",
}
