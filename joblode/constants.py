"""Fixed values of the job-posting domain.

Every list, phrase, address and bound below is a value that results depend on,
stated as is; code elsewhere only refers to it.
"""

# -- fixed values: seeds of the crawl, in order of priority --------------------
KEYWORDS = (
    "software engineer", "software developer", "fullstack developer", "full stack developer",
    "developer", "software", "programmer", "r&d",
    "backend", "backend developer", "frontend", "frontend developer",
    "fullstack", "full stack", "web", "application", "systems",
    "python", "java", "javascript", "typescript", "go", "ruby", "php", "kotlin",
    "react", "angular", "html", "css",
    "data analyst", "data engineer", "data scientist", "ai", "machine learning",
    "deep learning", "nlp", "computer vision", "big data", "it", "bi",
    "cloud", "aws", "azure", "docker", "kubernetes", "devops", "ci cd",
    "database", "sql", "nosql", "mongodb", "postgres", "mysql",
    "security", "cyber", "infosec", "penetration", "appsec",
    "android", "ios", "mobile", "flutter", "react native",
    "qa", "automation",
    "algorithm", "algorithms", "microservices", "api", "integration", "network", "linux",
    "infrastructure", "platform", "sre", "site reliability",
    "spark", "kafka", "hadoop", "etl", "pipeline",
    "embedded", "firmware",
)

# -- fixed values: accepted roles and seniorities -----------------------------
VALID_ROLES = (
    "Software Development", "Frontend", "Backend", "Fullstack", "AI / ML",
    "Data Scientist", "Data Engineer", "Data Analyst", "BI", "DevOps / Cloud",
    "Mobile", "QA / Automation", "Security", "Embedded / Firmware", "Database",
    "Network", "System Engineer", "Team Lead", "Product Manager",
    "Solutions Architect", "R&D", "Other",
)
VALID_SENIORITY = (
    "Intern", "Junior", "Mid", "Senior", "Lead", "Staff",
    "Principal", "Manager", "Director", "VP", "Not specified",
)
LEADERSHIP = ("Lead", "Staff", "Principal", "Manager", "Director", "VP")
DEFAULT_ROLE = "Other"
DEFAULT_SENIORITY = "Not specified"

# -- fixed values: role by words of the title, first matching row wins ---------
ROLE_WORDS = (
    ("Frontend", ("frontend", "front-end", "front end", "ui developer", "react developer",
                  "angular developer", "vue developer", "web developer")),
    ("Backend", ("backend", "back-end", "back end", "server-side", "node developer")),
    ("Fullstack", ("fullstack", "full-stack", "full stack")),
    ("AI / ML", ("machine learning", "deep learning", "nlp", "computer vision", "llm",
                 "ai engineer", "ml engineer", "artificial intelligence")),
    ("Data Scientist", ("data scientist",)),
    ("Data Engineer", ("data engineer", "etl", "pipeline engineer")),
    ("Data Analyst", ("data analyst", "bi developer", "business intelligence")),
    ("DevOps / Cloud", ("devops", "cloud engineer", "sre", "site reliability",
                        "platform engineer", "infrastructure engineer")),
    ("Mobile", ("mobile", "android", "ios", "flutter", "react native")),
    ("QA / Automation", ("qa ", "quality engineer", "automation engineer", "test engineer",
                         "sdet")),
    ("Security", ("security", "cyber", "infosec", "penetration", "appsec")),
    ("Embedded / Firmware", ("embedded", "firmware")),
    ("Solutions Architect", ("solutions architect", "solution architect", "system architect")),
    ("Team Lead", ("team lead", "tech lead", "engineering manager")),
    ("Software Development", ("software engineer", "software developer", "programmer",
                              "developer", "engineer")),
)
PRODUCT_ROLE = "Product Manager"
PRODUCT_WORDS = ("product lead", "vp product", "head of product", "product owner")

# -- fixed values: words of a posting's age, English and Hebrew ----------------
AGE_WORDS = (
    ("hour", ("שעה", "שעות", "hour")),
    ("day", ("יום", "ימים", "day")),
    ("week", ("שבוע", "שבועות", "week")),
    ("month", ("חודש", "חודשים", "month")),
    ("now", ("עכשיו", "just", "moments")),
)
AGE_DAYS = {"day": 1, "week": 7, "month": 30}

# -- fixed values: addresses ---------------------------------------------------
DEFAULT_SOURCE = "linkedin"
SEARCH_BASE = "https://il.linkedin.com/jobs/search/"
SEARCH_PLACE = "Israel"
SEARCH_RECENCY = "r604800"  # posted within seven days
DETAIL_BASE = "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/"

# -- fixed values: bounds ------------------------------------------------------
DAILY_TARGET = 50
MAX_PAGES = 2
MIN_PAGE_CARDS = 5
MIN_DESCRIPTION = 50
MISSING = "N/A"

# -- fixed values: texts that get a vector of their own ------------------------
FIELD_VECTORS = ("skills_must", "skills_nice", "description", "title", "role", "company",
                 "location")
METADATA_SCALARS = ("id", "title", "role", "seniority", "company", "location", "url",
                    "yearsexperience", "keyword", "source")
METADATA_LISTS = ("skills_must", "skills_nice", "past_experience")

# -- fixed values: layout of the full text of a posting ------------------------
# {name} is the column printed as is, {name*} a list joined by commas.
FULL_TEXT = """Job Title: {title}
Role: {role}
Seniority: {seniority}
Company: {company}
Location: {location}

Required Skills: {skills_must*}
Nice Skills: {skills_nice*}
Experience: {yearsexperience} years
Past Experience: {past_experience*}

Description:
{description}"""

# -- fixed values: layout of an extraction request -----------------------------
REQUEST_TITLE = "Job Title: "
REQUEST_BODY = "\n\nJob Description:\n"
REQUEST_END = "\n\nJSON:"

# -- fixed values: wording that marks optional skills and past experience ------
OPTIONAL_MARKS = ("advantage", "preferred", "bonus", "nice to have")
REFUSALS = ("no ", "not found", "couldn't find", "unable", "don't have",
            "general industry knowledge", "0 result", "no jobs")

# -- fixed values: names of the question tools ---------------------------------
TOOL_NAMES = ("semantic_search_jobs", "get_job_details", "get_job_aggregate",
              "get_column_distribution", "search_jobs_by_criteria", "top_skills",
              "top_skills_all")

# What ``str.strip`` of Python takes for white space.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          + "".join(map(chr, range(0x2000, 0x200b)))
          + "\u2028\u2029\u202f\u205f\u3000")
