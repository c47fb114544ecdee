"""Word lists, weights, limits and patterns that results depend on."""

# Technical keywords and their weights in hundredths.
TECH_WEIGHTS = {
    "python": 100, "javascript": 100, "typescript": 100, "java": 100, "golang": 100, "rust": 100, "php": 100, "ruby": 100, "c++": 100, "c#": 100, "kotlin": 100, "swift": 100, "scala": 100,
    "react": 90, "vue": 90, "angular": 90, "svelte": 90, "django": 90, "flask": 90, "fastapi": 90, "express": 90, "spring": 90, "laravel": 90, "rails": 90,
    "docker": 80, "kubernetes": 80, "aws": 80, "azure": 80, "gcp": 80, "terraform": 80, "ansible": 80, "jenkins": 80,
    "postgresql": 80, "mysql": 80, "mongodb": 80, "redis": 80, "elasticsearch": 80, "cassandra": 80,
    "api": 70, "rest": 70, "graphql": 70, "microservices": 80, "devops": 80, "ci/cd": 80, "testing": 70, "debugging": 70, "performance": 70, "security": 80, "authentication": 70,
    "machine learning": 100, "artificial intelligence": 100, "deep learning": 100, "neural networks": 100, "tensorflow": 90, "pytorch": 90, "scikit-learn": 90, "nlp": 90,
    "git": 60, "github": 60, "gitlab": 60, "vscode": 60, "webpack": 70, "babel": 70, "npm": 60, "yarn": 60,
    "tutorial": 50, "guide": 50, "documentation": 60, "best practices": 70, "architecture": 80, "design patterns": 80, "algorithm": 80, "data structure": 80,
}
# Indicators of depth and their weights in tenths.
DEPTH_WEIGHTS = {
    "code example": 3, "source code": 3, "github": 2, "step by step": 2, "complete guide": 3, "detailed": 2, "comprehensive": 2, "in-depth": 3, "advanced": 2, "production": 3, "real world": 3, "case study": 3,
    "learn": 1, "understand": 1, "explain": 1, "introduction": 1, "beginner": 1, "getting started": 1,
    "2024": 2, "2023": 1, "latest": 1, "new": 1, "updated": 1, "modern": 1,
}
# Phrases that lower or raise the language score.
CLICKBAIT = ["click here", "read more", "amazing", "incredible", "you won't believe", "secret", "hack"]
TECHNICAL_TERMS = ["implementation", "architecture", "methodology", "framework", "library", "algorithm", "optimization"]
GUIDE_PHRASES = ["how to", "step by step", "introduction to", "overview of", "guide to", "tutorial on"]
# Keywords of technical relevance and bonuses of domains in hundredths.
RELEVANT_WORDS = ["python", "javascript", "java", "typescript", "go", "rust", "php", "ruby", "c++", "react", "vue", "angular", "django", "flask", "express", "spring", "api", "database", "docker", "kubernetes", "cloud", "devops", "ai", "machine learning", "tutorial", "guide", "documentation", "best practices", "development"]
DOMAIN_BONUS = {"github.com": 30, "stackoverflow.com": 30, "medium.com": 20, "dev.to": 30, "hackernoon.com": 20, "codepen.io": 20, "replit.com": 20, "codesandbox.io": 20}
# Reputation of domains.
REPUTABLE = ["github.com", "stackoverflow.com", "medium.com", "dev.to", "hackernoon.com", "freecodecamp.org", "codecademy.com", "coursera.org", "udemy.com", "pluralsight.com"]
KNOWN_TECH_SITES = ["github.com", "stackoverflow.com", "medium.com"]
ACADEMIC = [".edu", ".org", ".ac.uk", ".ac.fr"]
GOOD_SUBDOMAINS = ["blog", "docs", "api", "dev", "www", "news", "tech"]
SUSPICIOUS = ["[0-9]{4,}", "[^a-zA-Z0-9.-]", r"\.tk$|\.ml$|\.ga$|\.cf$"]
SECURITY_HEADERS = ["strict-transport-security", "x-content-type-options", "x-frame-options", "x-xss-protection"]
# Quality of HTML pages.
PAGE_INDICATORS = ["documentation", "tutorial", "guide", "example", "github", "source code", "open source", "api", "best practices", "learning", "education"]
PAGE_PATTERNS = ["<code[^>]*>", "<pre[^>]*>", r"github\.com", r"stackoverflow\.com", r"function\s*\(", r"class\s+\w+", r"import\s+\w+"]
PAGE_SPAM = ["click here", "buy now", "limited time", "amazing deal", "secret", "hack"]
# Words of the two article scores.
CRAWL_WORDS = ["code", "function", "class", "algorithm", "tutorial"]
EXTRACT_WORDS = ["function", "class", "method", "algorithm", "code", "example"]
# Categories by keyword, first match wins.
CATEGORIES = {
    "web_development": ["web", "frontend", "backend", "javascript", "react", "vue"],
    "mobile_development": ["mobile", "android", "ios", "flutter", "react native"],
    "data_science": ["data", "machine learning", "ai", "analytics", "python"],
    "devops": ["devops", "docker", "kubernetes", "ci/cd", "deployment"],
    "cloud": ["cloud", "aws", "azure", "gcp", "serverless"],
    "security": ["security", "cybersecurity", "encryption", "vulnerability"],
}
SOURCE_TYPES = {"blog": ["blog", "medium"], "docs": ["docs", "documentation"], "news": ["news"], "forum": ["forum", "stackoverflow"]}
# Candidates.
EXCLUDED_DOMAINS = ["facebook.com", "twitter.com", "linkedin.com", "instagram.com", "youtube.com", "amazon.com", "ebay.com", "wikipedia.org"]
CANDIDATE_WORDS = ["programming", "development", "code", "software", "tech", "tutorial", "guide", "api", "framework", "library"]
TECH_DOMAIN_WORDS = ["dev", "tech", "code", "github", "gitlab", "stackoverflow", "medium", "blog", "docs", "api", "tutorial", "guide", "programming", "software", "engineering", "data"]
TRENDING = ["AI tools 2024", "machine learning frameworks", "web3 development", "kubernetes best practices", "python libraries 2024", "javascript frameworks 2024", "devops automation", "cloud native development", "microservices architecture", "API design patterns"]
MODIFIERS = ["tutorial", "guide", "best practices", "tips", "2024"]
SOURCE_KINDS = ["website", "blog", "news", "docs", "forum", "api"]
LANGUAGES = ["en", "fr", "es", "de", "it"]
# Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by from or an at which not have but you".split(),
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au avec ce par plus ne se sont aux".split(),
    "es": "el la los las de del y en un una es que por para con no se su al lo como más sus pero le".split(),
    "de": "der die das und in den von zu mit ist des im nicht ein eine auf als auch es an für dem sich aus bei".split(),
    "it": "il lo la i gli le di del della e in un una che per con non si è da al come sono più dei".split(),
}
#: Sites that speak for a page that links to them.
GOOD_LINKS = ["github.com", "stackoverflow.com"]
#: Requests a second, burst and seconds between requests, by default and of known domains.
DEFAULT_LIMIT = (1.0, 3, 1.0)
DOMAIN_LIMITS = {
    **dict.fromkeys(["stackoverflow.com", "github.com", "medium.com", "reddit.com", "hackernews.com"], (0.5, 2, 2.0)),
    **dict.fromkeys(["docs.python.org", "developer.mozilla.org", "kubernetes.io", "docker.com"], (1.5, 5, 0.7)),
}
