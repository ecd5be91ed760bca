"""Word lists, places and colour/weight tables the results depend on.

They are stated here as plain text and in their natural order; every operator takes the
list as a parameter, so another deployment passes its own.
"""

# --- fixed values: seriousness scoring -------------------------------------------------
HUMOUR = [
    "comedy", "funny", "humor", "humour", "joke", "jokes", "joking", "hilarious",
    "laugh", "laughing", "lol", "haha", "rofl", "lmao", "amusing", "entertaining",
    "parody", "spoof", "satire", "satirical", "mimicry", "mimic", "imitation",
    "mock", "mocking", "mockery", "fake", "spoof", "trolling", "troll",
    "sarcasm", "sarcastic", "irony", "ironic", "cynical", "witty", "clever",
    "prank", "pranks", "pranking", "prankster", "trick", "hoax", "fake news",
    "clickbait", "staged", "acting", "drama", "theatrical",
    "entertainment", "show", "episode", "series", "vlog", "blogger", "youtuber",
    "reaction", "review", "unboxing", "challenge", "trend", "viral",
    "meme", "memes", "trending", "viral video", "for fun", "just kidding",
    "not serious", "dont take seriously", "don't take seriously",
]

SERIOUS = [
    "emergency", "urgent", "critical", "alert", "warning", "evacuation",
    "rescue", "relief", "disaster", "catastrophe", "crisis", "calamity",
    "breaking news", "news update", "live coverage", "report", "reporting",
    "journalist", "correspondent", "official", "government", "authorities",
    "damage", "destruction", "devastation", "casualties", "victims", "injured",
    "death", "fatalities", "missing", "trapped", "stranded",
    "ndrf", "army", "navy", "coast guard", "police", "fire brigade",
    "medical", "hospital", "ambulance", "shelter", "relief camp",
]

COASTAL = [
    "tsunami", "tidal wave", "storm surge", "coastal flooding", "sea level",
    "high tide", "low pressure", "cyclone", "hurricane", "typhoon",
    "coastal erosion", "sea wall", "embankment", "saltwater intrusion",
]

# --- fixed values: tag extraction ------------------------------------------------------
HAZARD_TAGS = [
    "flood", "flooding", "tsunami", "cyclone", "hurricane", "storm", "rain", "drought",
    "earthquake", "landslide", "coastal", "erosion", "weather", "disaster", "emergency",
    "rescue", "evacuation", "alert", "warning", "damage", "destruction", "relief",
    "mumbai", "chennai", "kolkata", "kerala", "gujarat", "odisha", "bengal", "tamil",
    "monsoon", "heavy", "extreme", "severe", "urgent", "breaking", "live",
]

PLACES = (
    "mumbai|chennai|kolkata|delhi|bengaluru|hyderabad|ahmedabad|pune|surat|jaipur|"
    "lucknow|kanpur|nagpur|visakhapatnam|indore|thane|bhopal|pimpri|patna|vadodara|"
    "ghaziabad|ludhiana|agra|nashik|faridabad|meerut|rajkot|kalyan|vasai|varanasi|"
    "srinagar|aurangabad|dhanbad|amritsar|navi mumbai|allahabad|ranchi|howrah|"
    "coimbatore|jabalpur|gwalior|vijayawada|jodhpur|madurai|raipur|kota|guwahati|"
    "chandigarh|solapur|hubballi|tiruchirappalli|salem|mira bhayandar|"
    "thiruvananthapuram|bhiwandi|saharanpur|guntur|bikaner|amravati|noida|jamshedpur|"
    "bhilai|warangal|cuttack|firozabad|kochi|bhavnagar|dehradun|durgapur|asansol|"
    "rourkela|nanded|kolhapur|ajmer|akola|gulbarga|jamnagar|ujjain|loni|siliguri|"
    "jhansi|ulhasnagar|jammu|sangli miraj kupwad|mangalore|erode|belgaum|ambattur|"
    "tirunelveli|malegaon|gaya|jalgaon|udaipur|maheshtala|kerala|karnataka|tamil nadu|"
    "andhra pradesh|telangana|maharashtra|gujarat|rajasthan|west bengal|odisha|bihar|"
    "uttar pradesh|madhya pradesh|punjab|haryana|himachal pradesh|uttarakhand|"
    "jharkhand|chhattisgarh|assam|meghalaya|manipur|tripura|mizoram|arunachal pradesh|"
    "nagaland|sikkim|goa"
).split("|")

COMMON_WORDS = (
    "the and for are but not you all can had her was one our out day get has him his "
    "how may new now old see two way who boy did its let put say she too use with have "
    "this will your from they know want been good much some time very when come here "
    "just like long make many over such take than them well were"
).split()

COASTAL_TERMS = ["coastal", "tsunami", "storm surge", "tidal", "ocean", "sea"]

# --- fixed values: news and alert monitors ---------------------------------------------
FLOOD_WORDS = [
    "flood", "flooded", "flooding", "floods", "inundated", "waterlogged",
    "deluge", "submerg", "overflow", "rain", "monsoon", "cyclone",
    "hurricane", "tsunami", "storm surge", "heavy rain",
]

INDIA_WORDS = [
    "india", "indian", "mumbai", "delhi", "kolkata", "chennai", "bangalore",
    "hyderabad", "pune", "ahmedabad", "kerala", "maharashtra", "gujarat",
    "bihar", "west bengal", "odisha", "assam", "goa", "uttarakhand",
]

# --- fixed values: severity, urgency and first-person labels ---------------------------
SEVERITY_WORDS = {
    "extreme": ["catastrophic", "devastating", "extreme", "severe", "massive",
                "unprecedented", "historic"],
    "high": ["heavy", "intense", "major", "serious", "significant", "dangerous",
             "critical"],
    "medium": ["moderate", "considerable", "notable", "substantial", "strong"],
    "low": ["light", "minor", "slight", "small", "weak"],
}

URGENCY_WORDS = {
    "critical": ["breaking", "urgent", "emergency", "alert", "immediate", "crisis"],
    "high": ["warning", "live", "now", "today", "current", "developing"],
    "medium": ["recent", "latest", "update", "ongoing"],
    "low": ["report", "news", "information"],
}

FIRST_PERSON = [
    "i am", "we are", "my house", "our area", "i saw", "i experienced",
    "happening here", "in my city", "my family", "our village", "i live",
    "from my window", "outside my house", "in our locality",
]

# --- fixed values: map ------------------------------------------------------------------
DISASTER_TYPES = ["flood", "cyclone", "earthquake", "landslide",
                  "tsunami", "drought", "fire", "heavy_rain"]
PLATFORMS = ["twitter", "facebook", "youtube", "news", "instagram"]
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.2}
DEFAULT_POINT = (20.5, 78.9, "Unknown")

# name, latitude, longitude, state
GAZETTEER = [
    ("Mumbai", 19.0760, 72.8777, "Maharashtra"),
    ("Chennai", 13.0827, 80.2707, "Tamil Nadu"),
    ("Kolkata", 22.5726, 88.3639, "West Bengal"),
    ("Kochi", 9.9312, 76.2673, "Kerala"),
    ("Visakhapatnam", 17.6868, 83.2185, "Andhra Pradesh"),
    ("Paradip", 20.3164, 86.6085, "Odisha"),
    ("Mangalore", 12.9141, 74.8560, "Karnataka"),
    ("Goa", 15.2993, 74.1240, "Goa"),
    ("Puri", 19.8135, 85.8312, "Odisha"),
    ("Surat", 21.1702, 72.8311, "Gujarat"),
    ("Ratnagiri", 16.9902, 73.3120, "Maharashtra"),
    ("Tuticorin", 8.7642, 78.1348, "Tamil Nadu"),
    ("Kakinada", 16.9891, 82.2475, "Andhra Pradesh"),
    ("Bhubaneswar", 20.2961, 85.8245, "Odisha"),
    ("Thiruvananthapuram", 8.5241, 76.9366, "Kerala"),
    ("Delhi", 28.7041, 77.1025, "Delhi"),
    ("Bengaluru", 12.9716, 77.5946, "Karnataka"),
    ("Hyderabad", 17.3850, 78.4867, "Telangana"),
    ("Ahmedabad", 23.0225, 72.5714, "Gujarat"),
    ("Pune", 18.5204, 73.8567, "Maharashtra"),
    ("Jaipur", 26.9124, 75.7873, "Rajasthan"),
    ("Lucknow", 26.8467, 80.9462, "Uttar Pradesh"),
    ("Patna", 25.6093, 85.1376, "Bihar"),
    ("Nagpur", 21.1458, 79.0882, "Maharashtra"),
    ("Indore", 22.7196, 75.8577, "Madhya Pradesh"),
    ("Bhopal", 23.2599, 77.4126, "Madhya Pradesh"),
    ("Shimla", 31.1048, 77.1734, "Himachal Pradesh"),
    ("Dehradun", 30.3165, 78.0322, "Uttarakhand"),
    ("Guwahati", 26.1445, 91.7362, "Assam"),
    ("Imphal", 24.8170, 93.9368, "Manipur"),
    ("Gangtok", 27.3389, 88.6065, "Sikkim"),
    ("Ranchi", 23.3441, 85.3096, "Jharkhand"),
    ("Raipur", 21.2514, 81.6296, "Chhattisgarh"),
    ("Wayanad", 11.6854, 76.1320, "Kerala"),
    ("Uttarkashi", 30.7268, 78.4354, "Uttarakhand"),
]

# --- fixed values: rasters --------------------------------------------------------------
BAND_MEANS = [0.033349706741586264, 0.05701185520536176, 0.05889748132001316,
              0.2323245113436119, 0.1972854853760658, 0.11944914225186566]
BAND_STDS = [0.02269135568823774, 0.026807560223070237, 0.04004109844362779,
             0.07791732423672691, 0.08708738838140137, 0.07241979477437814]
SIX_OF_THIRTEEN = [2, 3, 4, 9, 11, 12]
NODATA = -9999.0
FLOOD_RES_M = 10.0
FIRE_RES_M = 30.0
RADAR_RULE = {"vv": 100.0, "vh": 90.0, "delta": 10.0, "vv_min": 75.0, "vh_min": 70.0}
LAYER_COLOURS = {
    "existing_water": "#00BFFF", "new_flood": "#FF004D", "burn_scar": "#FF6600",
    "ground_truth": "#FF0000", "true_positive": "#00CC44", "false_positive": "#FF004D",
    "false_negative": "#FFA500",
}
