"""Constants and schemas of a corpus of knowledge files."""

# Fixed values of the data model.
CATEGORIES = ("identity", "opinions", "style", "decisions", "feedback", "knowledge", "tasks", "expertise", "goals")
CATEGORY_KEYWORDS = {
    "identity": ["name", "background", "role", "personal", "bio", "i", "me", "my", "work", "job", "title", "live", "born", "age", "experience"],
    "opinions": ["prefer", "think", "believe", "opinion", "like", "dislike", "love", "hate", "feel", "view", "perspective", "rather", "better", "worse", "favor"],
    "style": ["style", "format", "convention", "pattern", "approach", "structure", "organize", "layout", "naming", "indent", "write", "code"],
    "decisions": ["decision", "chose", "decided", "tradeoff", "why", "reason", "because", "instead", "choose", "pick", "select", "adopt"],
    "knowledge": ["how", "what", "fact", "reference", "documentation", "know", "learn", "understand", "concept", "definition", "explain", "guide"],
}
K1, B = 1.5, 0.5
BOOST = {"tag": 3.0, "path": 2.0, "content": 1.0}
RRF_K = 60
FEEDBACK_CHUNKS, FEEDBACK_TERMS, FEEDBACK_LEAST = 3, 5, 1.0
CHUNKS_PER_FILE, CONTEXT_FILES = 2, 5
PROFILE = "identity/profile.md"

DOCS = "path string, tags array<string>, confidence string, source string, updated date, access_count int, last_accessed date, content string"
LEARNINGS = "array<struct<category:string,topic:string,tags:array<string>,content:string,confidence:string,action:string,source:string>>"
MESSAGES = "array<struct<role:string,content:string>>"
SESSION = "id string, started_at timestamp, updated_at timestamp, provider string, messages array<struct<role:string,content:string,timestamp:timestamp,brain_files_used:array<string>,confidence:string>>, learnings_extracted int"
