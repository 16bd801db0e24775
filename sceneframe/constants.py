"""Word lists, limits, tables and defaults the results depend on."""

# --- files -----------------------------------------------------------------
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp", "heic"]
AUDIO_EXTENSIONS = ["mp3", "m4a", "wav", "aac", "flac", "ogg", "opus", "wma"]
TEXT_EXTENSIONS = ["txt", "md"]
POSITIONAL_TEXT_EXTENSIONS = ["txt"]
MANIFEST_COLUMNS = [
    "image", "text", "audio_file", "voice", "duration", "zoom_direction", "zoom_anchor", "caption",
]
MIN_NUMBER_WIDTH = 3
MAX_SCRIPT_BYTES = 256 * 1024
MAX_CHAPTER_BYTES = 4 * 1024 * 1024
SCENES_WORTH_LISTING = 20
RECENT_PROJECTS = 30
SPARE_GENERATIONS = 2

# --- scenes ----------------------------------------------------------------
MAX_SCENE_SECONDS = 3600.0
DEFAULT_VOICE_WORD = "default"
WARNING_KINDS = ["unpaired_file", "unlisted_image", "undersized_sources", "undrawable_caption"]

# --- settings defaults and limits ------------------------------------------
DEFAULT_OUTPUT = "out.mp4"
DEFAULT_ASPECT = "16:9"
DEFAULT_SHORT_EDGE = 1080
DEFAULT_FPS = 30
DEFAULT_PROVIDER = "edge"
DEFAULT_TRIM_HEAD = 0.10
DEFAULT_TRIM_TAIL = 0.25
DEFAULT_SUBTITLES = False
DEFAULT_THEME = "classic"
DEFAULT_PLACEMENT = "bottom"
DEFAULT_SILENT_SECONDS = 4.0
DEFAULT_AMOUNT = 0.10
DEFAULT_MOTION_SEED = "v1"
DEFAULT_PRESET = "medium"
DEFAULT_CRF = 18
MAX_CRF = 51
MAX_TRIM_SECONDS = 10.0

# --- geometry --------------------------------------------------------------
MAX_MACROBLOCKS = 36_864
ASPECT_WORDS = {
    "16:9": ["16:9", "landscape", "wide", "youtube"],
    "9:16": [
        "9:16", "portrait", "vertical", "shorts", "short", "youtube-shorts", "reel", "reels",
        "tiktok", "story", "stories",
    ],
    "1:1": ["1:1", "square"],
}
SIZE_WORDS = {
    720: ["720p", "720", "hd"],
    1080: ["1080p", "1080", "fhd", "full-hd"],
    1440: ["1440p", "1440", "2k", "qhd"],
    2160: ["2160p", "2160", "4k", "uhd"],
}
# (level, most macroblocks in a frame, most macroblocks in a second)
H264_LEVELS = [
    (10, 99, 1_485),
    (11, 396, 3_000),
    (12, 396, 6_000),
    (13, 396, 11_880),
    (20, 396, 11_880),
    (21, 792, 19_800),
    (22, 1_620, 20_250),
    (30, 1_620, 40_500),
    (31, 3_600, 108_000),
    (32, 5_120, 216_000),
    (40, 8_192, 245_760),
    (41, 8_192, 245_760),
    (42, 8_704, 522_240),
    (50, 22_080, 589_824),
    (51, 36_864, 983_040),
    (52, 36_864, 2_073_600),
]
LEVEL_FLOOR = 40
LEVEL_CEILING = 52

# --- motion ----------------------------------------------------------------
MOTION_KINDS = ["zoom-in", "zoom-out", "pan-left", "pan-right", "pan-up", "pan-down"]
ANCHOR_WORDS = {
    "center": ["center", "centre", "middle", "c"],
    "north": ["north", "top", "n"],
    "south": ["south", "bottom", "s"],
    "west": ["west", "left", "w"],
    "east": ["east", "right", "e"],
    "north-west": ["north-west", "top-left", "left-top", "nw"],
    "north-east": ["north-east", "top-right", "right-top", "ne"],
    "south-west": ["south-west", "bottom-left", "left-bottom", "sw"],
    "south-east": ["south-east", "bottom-right", "right-bottom", "se"],
}
MIN_AMOUNT = 0.02
MAX_AMOUNT = 0.50

# --- chapters --------------------------------------------------------------
CHARS_PER_SECOND = 16.3
MAX_PIECE_SECONDS = 5.0
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "st", "jr", "sr", "prof", "vs", "etc", "e.g", "i.e", "mt"]
CLAUSE_OPENERS = [
    "and", "but", "or", "so", "then", "when", "while", "as", "because", "though", "although",
    "until", "before", "after", "where", "which",
]
DANGLING_WORDS = [
    "a", "an", "the", "and", "or", "but", "nor", "of", "to", "in", "on", "at", "for", "with",
    "from", "by", "as", "into", "onto", "over", "under", "than", "that", "which", "who", "if",
    "his", "her", "their", "my",
]

# --- captions --------------------------------------------------------------
MIN_CUE_SECONDS = 0.9
MAX_CUES = 60
SMALLEST_BUDGET = 8
WEAK_ENDINGS = [
    "a", "an", "the", "and", "or", "but", "nor", "so", "yet", "of", "to", "in", "on", "at", "for",
    "with", "from", "by", "as", "into", "onto", "over", "under", "than", "that", "which", "who",
    "if", "when", "while", "because", "though", "although", "before",
]
NAMED_CHARACTERS = 8
THEME_MAX_CHARS = {
    "classic": 88, "boxed": 84, "band": 80, "card": 80, "punch": 62, "minimal": 76,
    "recap": 28, "bold": 22, "glow": 26, "pill": 24,
}
# Code points the caption faces draw: Latin, Greek, Cyrillic, Devanagari, and their punctuation.
DRAWN_RANGES = [
    (0x0000, 0x024F), (0x02B0, 0x03FF), (0x0400, 0x052F), (0x0900, 0x097F), (0x1E00, 0x1FFF),
    (0x2000, 0x206F), (0x20A0, 0x20CF), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
]

# --- audio -----------------------------------------------------------------
SAMPLE_RATE = 48_000
LOUDNESS_TARGET_LUFS = -16.0
TRUE_PEAK_CEILING_DBTP = -1.5
MAX_GAIN_DB = 24.0
SMALLEST_GAIN_DB = 0.05
SILENCE_MIN_SECONDS = 0.05
AAC_FRAME_SECONDS = 1024.0 / 48_000.0

# --- segment profile -------------------------------------------------------
PROFILE_CONTAINER = "mov,mp4,m4a,3gp,3g2,mj2"
PROFILE_STREAM_ORDER = "video, audio"
PROFILE_VIDEO = {
    "codec_name": "h264",
    "profile": "High",
    "pix_fmt": "yuv420p",
    "color_range": "tv",
    "color_space": "bt709",
    "color_primaries": "bt709",
    "color_transfer": "bt709",
    "sample_aspect_ratio": "1:1",
    "time_base": "1/90000",
}
PROFILE_AUDIO = {
    "codec_name": "aac",
    "profile": "LC",
    "sample_fmt": "fltp",
    "sample_rate": "48000",
    "channels": "2",
    "channel_layout": "stereo",
    "time_base": "1/48000",
}

# --- speech service --------------------------------------------------------
COOLDOWN_SECONDS = 15
MAX_COOLDOWN_SECONDS = 120
PATIENCE_SECONDS = 60 * 60
PATIENCE_COLD_SECONDS = 3 * 60
ANNOUNCE_SECONDS = 10 * 60
PERMANENT_MARKERS = [
    "NoAudioReceived", "ValueError", "TypeError", "usage: edge-tts", "unrecognized arguments",
    "No such file or directory", "Permission denied", "ModuleNotFoundError",
]
TRANSIENT_MARKERS = [
    "WebSocketError", "UnexpectedResponse", "UnknownResponse", "SkewAdjustmentError", "aiohttp",
    "websockets", "ClientConnector", "ServerDisconnected", "ConnectionResetError",
    "ConnectionRefusedError", "TimeoutError", "socket.gaierror", "ssl.SSLError",
    "Temporary failure in name resolution",
]
NETWORK_MARKERS = [
    "ClientConnectorDNSError", "socket.gaierror", "nodename nor servname provided",
    "Temporary failure in name resolution", "getaddrinfo failed", "Network is unreachable",
    "No route to host",
]
PROVIDER_DEFAULT_VOICE = "en-US-AvaNeural"
DEFAULT_VOICES = {
    "hi": "hi-IN-MadhurNeural",
    "bn": "bn-IN-BashkarNeural",
    "gu": "gu-IN-NiranjanNeural",
    "ta": "ta-IN-ValluvarNeural",
    "te": "te-IN-MohanNeural",
    "kn": "kn-IN-GaganNeural",
    "ml": "ml-IN-MidhunNeural",
    "si": "si-LK-SameeraNeural",
    "el": "el-GR-NestorasNeural",
    "ru": "ru-RU-DmitryNeural",
    "he": "he-IL-AvriNeural",
    "ar": "ar-EG-ShakirNeural",
    "th": "th-TH-NiwatNeural",
    "lo": "lo-LA-ChanthavongNeural",
    "ja": "ja-JP-KeitaNeural",
    "my": "my-MM-ThihaNeural",
    "ka": "ka-GE-GiorgiNeural",
    "am": "am-ET-AmehaNeural",
    "km": "km-KH-PisethNeural",
    "ko": "ko-KR-InJoonNeural",
    "zh": "zh-CN-YunxiNeural",
}
# Script ranges, in tie-breaking order.
SCRIPTS = [
    ("hi", [(0x0900, 0x097F), (0xA8E0, 0xA8FF)]),
    ("bn", [(0x0980, 0x09FF)]),
    ("pa", [(0x0A00, 0x0A7F)]),
    ("gu", [(0x0A80, 0x0AFF)]),
    ("or", [(0x0B00, 0x0B7F)]),
    ("ta", [(0x0B80, 0x0BFF)]),
    ("te", [(0x0C00, 0x0C7F)]),
    ("kn", [(0x0C80, 0x0CFF)]),
    ("ml", [(0x0D00, 0x0D7F)]),
    ("si", [(0x0D80, 0x0DFF)]),
    ("el", [(0x0370, 0x03FF), (0x1F00, 0x1FFF)]),
    ("ru", [(0x0400, 0x04FF), (0x0500, 0x052F)]),
    ("hy", [(0x0530, 0x058F)]),
    ("he", [(0x0590, 0x05FF)]),
    ("ar", [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)]),
    ("th", [(0x0E00, 0x0E7F)]),
    ("lo", [(0x0E80, 0x0EFF)]),
    ("ja", [(0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF)]),
    ("my", [(0x1000, 0x109F)]),
    ("ka", [(0x10A0, 0x10FF)]),
    ("am", [(0x1200, 0x137F)]),
    ("km", [(0x1780, 0x17FF)]),
    ("ko", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("zh", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]),
]

# --- logs ------------------------------------------------------------------
SECRET_MARKERS = [
    "api_key", "apikey", "api-key", "secret", "password", "passwd", "token", "authorization",
    "bearer ", "xi-api-key", "access_key", "private_key", "credential",
]
REDACTED = "[redacted]"
RUNS_COLUMNS = ["when", "level", "scope", "project", "what happened", "details", "folder"]
