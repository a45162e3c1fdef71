"""Word lists, patterns and labels that results depend on, in plain text. Code that uses them is elsewhere."""

from __future__ import annotations

VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".rm", ".rmvb", ".m4v", ".webm", ".mpg", ".mpeg", ".ts", ".m2ts", ".vob", ".3gp")

NON_CATALOG_PREFIXES = (
    "cd", "disc", "disk", "part", "pt", "season", "episode", "vol", "volume", "web", "hdr", "avc", "hevc", "xvid", "divx", "mp",
    "hd", "sd", "fhd", "uhd", "vd", "video", "movie", "film", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x",
)
HEIGHTS = ("2160", "1440", "1080", "720", "576", "480", "360")
HEIGHT_PREFIXES = ("video", "movie", "film", "uhd", "fhd", "hd", "sd", "vd")
ORDINAL_WORDS = ("episode", "part", "chapter", "vol", "volume")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}

NOISE_TOKENS = (
    "4k", "8k", "uhd", "fhd", "hd", "sd", "vd", "hdr", "hdr10", "dolbyvision",
    "2160p", "1440p", "1080p", "1080i", "720p", "576p", "480p", "360p",
    "bluray", "bdrip", "brrip", "dvdrip", "hdtv", "webrip", "webdl", "remux",
    "cam", "ts", "tc", "xvid", "divx", "x264", "x265", "h264", "h265",
    "hevc", "av1", "aac", "ac3", "dts", "flac", "atmos", "10bit", "8bit",
    "proper", "repack", "internal", "limited", "extended", "uncut", "directorscut",
    "mp4", "mkv", "mov", "avi", "wmv", "flv", "rm", "rmvb", "m4v",
    "webm", "mpg", "mpeg", "m2ts", "vob", "3gp",
    "中字", "中英", "字幕", "双语", "国语", "国配", "粤语", "英语", "日语", "韩语",
    "简体", "繁体", "简中", "繁中", "chs", "cht", "eng", "sub", "subs",
    "subbed", "dub", "dubbed", "c", "uc", "uncensored", "censored", "sample",
)
RELEASE_GROUPS = (
    "rarbg", "yts", "yify", "ettv", "eztv", "ion10", "ctrlhd", "mteam", "cmct", "frds", "beasts", "hdchina", "ourbits",
    "ptp", "ntb", "flux", "tigole", "qxr", "joy", "playweb", "cakes", "sparks", "amiable", "geckos", "fgt",
)
NOISE_PATTERNS = (
    "[0-9]{3,4}[pi]", "(?:2160|1440|1080|720|576|480|360)", "(?:vd|hd|fhd|uhd)(?:2160|1440|1080|720|576|480|360)[pi]?",
    "(?:x|h)[._-]?(?:264|265)", "[0-9]+(?:bit|fps)",
)
PROMOTIONS = (
    "电影天堂", "影视天堂", "电影下载", "高清下载", "迅雷下载", "资源发布", "经典剧情", "经典影片", "经典电影", "最新电影", "热门电影", "高清电影",
    "高清影视", "精品影视", "影视分享", "资源分享", "珍藏版", "收藏版", "完整版", "未删减版", "未删减", "正片", "电影版",
)
COMPOUND_NOISE = (
    "国语中字", "粤语中字", "英语中字", "日语中字", "韩语中字", "国粤双语", "国英双语", "中英双语", "双语字幕", "中英双字", "简繁中字", "简繁字幕",
    "内嵌中字", "中文字幕", "中文硬字幕", "中英文字幕", "官方中字", "外挂中字", "中字国语", "中字粤语",
)
NOISE_PHRASES = r"web[\s._-]*dl|blu[\s._-]*ray|dolby[\s._-]*vision|director[\s._-]*s?[\s._-]*cut"
DOMAINS = "com|net|org|tv|cc|cn|me|io|xyz|site|info|club|top|co|uk|jp|la"
BRACKETS = "《》【】[]（）()「」『』〈〉“”‘’\"'"
PARTS_OF_A_WORK = "上集|下集|上部|下部|上篇|下篇|上|下"
STREAMING_FAMILIES = "1pondo|10musume|caribbeancom|pacopacomama"

DISC_FOLDERS = ("video_ts", "audio_ts", "bdmv", "stream", "clipinf", "playlist", "certificate", "avchd", "private")
LIBRARY_FOLDERS = (
    "movie", "movies", "video", "videos", "media", "download", "downloads", "complete", "completed", "new folder", "新建文件夹", "电影", "影片",
    "影视", "视频", "下载", "成人", "av", "jav",
)

INCOMPLETE_SUFFIXES = (".part", ".partial", ".tmp", ".temp", ".crdownload", ".download", ".!qb")
HIDDEN, SYSTEM, REPARSE = 0x2, 0x4, 0x400

EXTENSION_RANK = {".mkv": 10, ".mp4": 9, ".mov": 8, ".m4v": 8, ".webm": 7, ".avi": 6, ".m2ts": 6, ".ts": 5, ".wmv": 4, ".flv": 3, ".rmvb": 2, ".rm": 1}

ACTIONS = ("未决定", "保留", "删除", "忽略")
UNDECIDED, KEEP, DELETE, IGNORE = ACTIONS
MATCH_LABELS = {"hash": "MD5", "mixed": "混合", "name": "作品身份"}
IDENTITY_LABELS = {"catalog": "作品编号", "dated_episode": "系列日期单集", "series_episode": "季集编号", "title": "影视标题", "generic_media": "光盘通用文件名"}

HASH_NONE, HASH_FULL, HASH_SMALL, HASH_CACHED = "未计算", "完整 MD5", "完整 MD5（小文件快速阶段）", "缓存 MD5（快速指纹已验证）"
HASH_QUICK, HASH_DIFFERENT, HASH_FAILED = "快速指纹已计算", "快速指纹不同，跳过完整 MD5", "计算失败"
SAMPLE_BYTES = 1 << 20

REASONS = {
    "insufficient": "作品名称信息不足，无法安全确认是同一作品",
    "part": "同一作品的分段标记不同，不作为可互删的重复文件",
    "kind": "作品身份类型不同",
    "series": "系列名称不同",
    "date": "同一系列但作品日期不同",
    "episode_order": "系列、日期和单集标题相同，仅词语顺序不同",
    "episode_words": "系列与日期相同，但单集标题包含不同实质词语",
    "episode_title": "系列与日期相同，但单集标题不同",
    "episode_spelling": "系列、日期相同，单集标题存在轻微拼写差异",
    "episode_untitled": "系列与日期相同，其中一侧缺少单集标题",
    "episode_equal": "系列、日期和单集标题完全相同",
    "number": "同一系列但季集编号不同",
    "number_equal": "系列名称与季集编号完全相同",
    "catalog_equal": "作品编号完全相同",
    "catalog": "作品编号不同",
    "catalog_one": "一侧为作品编号，另一侧为普通标题",
    "year": "标题年份不同，为防止合并同名翻拍作品",
    "empty": "有效标题不足",
    "title_equal": "清理画质/格式标签后标题相同",
    "title_year": "标题相同，其中一侧包含发行年份",
    "title_alias": "标题与第一部别名相同",
    "title_order": "标题词语相同，仅排列顺序不同",
    "title_number": "作品标题中的数字或续集编号不同",
    "title_count": "作品标题包含不同的实质词语",
    "title_words": "作品标题共享系列词，但包含不同的实质词语",
    "title_length": "作品标题有效长度或覆盖度不足",
    "near": "解析后的作品标题几乎一致",
    "typo": "解析后的作品标题存在轻微拼写差异",
    "far": "作品标题差异较大",
    "same_content": "文件大小与完整 MD5 均相同",
    "mixed": "组内既有 MD5 完全相同文件，也有作品身份相同的不同版本",
}

REPORT_COLUMNS = (
    "候选组", "候选作品", "身份/依据", "匹配原因", "辅助提示", "重点复核", "置信度", "决定", "文件名", "识别作品", "身份类型", "身份来源", "来源文本", "作品身份键",
    "作品编号", "分段标记", "系列名称键", "单集日期", "季集编号", "完整路径", "所在目录", "大小(字节)", "MD5", "MD5状态", "内容关系", "分辨率",
    "时长(秒)", "编码", "格式", "修改时间", "扫描快照时间戳", "报告版本",
)
REQUIRED_REPORT_COLUMNS = ("候选组", "决定", "完整路径", "大小(字节)", "修改时间")

#: Simplified characters beside those of ICU's rules.
SIMPLIFIED_TOO = {"嶽": "岳"}

#: What a file's snapshot is said to differ in, and what becomes of it.
MISSING, LINK, NOT_REGULAR, MODIFIED = "文件不存在（可能已移动或已经删除）", "路径已变为符号链接，已按安全规则忽略", "路径当前不是普通文件，已按安全规则忽略", "文件修改时间已变化"
RESIZED = ("文件大小已变化（扫描时 ", " 字节，当前 ", " 字节）")
UNREADABLE, NETWORK, MOVED, NOT_MOVED = "无法读取当前文件状态：", "网络路径不能保证进入回收站，已拒绝操作", "已移入安全暂存目录：", "移动失败："
NO_SURVIVOR, NONE_INTACT = "候选组没有保留或未删除文件，为防止整组被删除已自动忽略", "候选组中没有状态正常的保留文件，为防止整组被删除已自动忽略"
SURVIVOR_CHANGED = "原保留/非删除文件状态异常："
CHOSE_GROUP, CHOSE_ALL, CHOSE_IGNORE = "；用户选择仅本组继续", "；用户选择本次后续同类情况全部继续", "；用户选择安全忽略本组"
CHOSEN_TO_IGNORE = "原保留文件状态异常，用户选择安全忽略本组"

#: The columns of the list of ignored files.
IGNORED_COLUMNS = ("忽略时间", "来源报告", "记录类型", "候选作品", "文件名", "完整路径", "忽略原因", "扫描时大小(字节)", "当前大小(字节)", "扫描时修改时间", "当前修改时间")

#: Options of a run where none are said.
SETTINGS = {
    "recursive": True, "similarity_mode": "严格作品识别（推荐）", "read_metadata": True, "hash_mode": "smart", "file_mode": "视频文件（推荐）", "name_matching_enabled": True, "comparison_scope": "all", "min_size_mb": "0", "max_size_mb": "0",
    "skip_hidden_system": True, "skip_incomplete": True, "exclude_name_keywords": "", "custom_extensions": ";".join(x[1:] for x in VIDEO_EXTENSIONS), "excluded_directories": [], "group_column_order": [], "detail_column_order": [],
    "window_geometry": "1280x820", "last_roots": [],
}

#: Patterns that names are read by (Java's; digits are ASCII).
CJK = "㐀-鿿"
KEPT = f"[^0-9a-z{CJK}]+"
NOISE = "(?:" + "|".join((*NOISE_TOKENS, *RELEASE_GROUPS, *NOISE_PATTERNS)) + ")"
EDGE = r"[\s._\-\[\]()（）【】]"
PART = rf"(?:^|{EDGE})(?:cd|disc|disk|part|pt)[\s._-]*0*([1-9][0-9]?)(?:$|{EDGE})"
CHINESE_PART = rf"(?:^|{EDGE})({PARTS_OF_A_WORK}|第\s*[一二三四五六七八九十0-9]+\s*[部集段篇])(?:$|{EDGE})"
DOMAIN = rf"(?:https?://)?(?:www\.)?(?:[a-z0-9-]+\.)+(?:{DOMAINS})(?::[0-9]+)?(?:/[^\s\[\]【】()]*)?"
BRAND = r"(?:^|[\s._-])(?:big|fun)?[0-9]{3,5}(?:社区|论坛|論壇)(?=$|[\s._-])"
COMPOUND = "|".join(COMPOUND_NOISE)
PROMOTION = "(?:" + "|".join(PROMOTIONS) + ")"
YEAR = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"
FULL_DATE = r"(?<![0-9])((?:19|20)[0-9]{2}|[0-9]{2})[\s._-]+(0?[1-9]|1[0-2])[\s._-]+(0?[1-9]|[12][0-9]|3[01])(?![0-9])"
COMPACT_DATE = r"(?:^|[\s._-])((?:19|20)[0-9]{6})(?=$|[\s._-])"
SEASON_EPISODE = r"(?:^|[\s._-])s(?:eason)?[\s._-]*0*([0-9]{1,2})[\s._-]*e(?:pisode)?[\s._-]*0*([0-9]{1,3})(?=$|[\s._-])"
X_EPISODE = r"(?:^|[\s._-])0*([0-9]{1,2})x0*([0-9]{1,3})(?=$|[\s._-])"
EPISODES = (
    r"(?:^|[\s._-])(?:e|ep|episode)[\s._-]*0*([0-9]{1,4})(?=$|[\s._-])",
    r"(?:^|[\s._-])第\s*0*([0-9]{1,4})\s*集(?=$|[\s._-])",
    r"(?:^|[\s._-])\(\s*0*([0-9]{1,5})\s*\)(?=$|[\s._-])",
)
LONG_SERIES = r"(?<![a-z0-9])([a-z]{8,})[\s._-]*0*([0-9]{2,6})(?![a-z0-9])"
FC2 = r"(?<![a-z0-9])fc2[\s._-]*ppv[\s._-]*([0-9]{3,9})(?![0-9])"
STREAMING = rf"(?<![a-z0-9])({STREAMING_FAMILIES})[\s._-]*([0-9]{{6}})[\s._-]+([0-9]{{1,4}})(?![0-9])"
TOKYO = r"(?<![a-z0-9])tokyo[\s._-]*hot[\s._-]*n[\s._-]*([0-9]{3,6})(?![0-9])"
# the rest of the text comes along as a group, by looking ahead
SEPARATED = r"(?<![a-z0-9])([a-z][a-z0-9]{1,11})([\s._-]+)([0-9]{1,7})(?![0-9])(?=(.*))"
COMPACT = r"(?<![a-z0-9])([a-z]{2,12})()([0-9]{2,7})(?![0-9])(?=(.*))"
SEGMENT_FOLDER = r"^(?:cd|disc|disk|dvd|part|pt)[\s._-]*0*([1-9][0-9]?)$"
DVD_STEM = r"^vts[\s._-]*0*([0-9]{1,2})[\s._-]+0*([0-9]{1,2})$"
DISC_STEM = r"^(video[\s._-]*ts|audio[\s._-]*ts|avseq|mpegav|title|track)[\s._-]*0*([0-9]{0,4})$"
NUMERIC_STEM = r"^0*([0-9]{1,6})$"
