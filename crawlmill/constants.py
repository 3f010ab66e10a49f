"""Fixed values and defaults of the data semantics."""

#: File extensions that are not collected.
IGNORED_EXTENSIONS = (
    "woff2 woff ttf otf eot tif tiff ico cur bmp webp svg png jpg jpeg jfif gif avif apng pjpeg pjp mov wav mpg mpeg "
    "mp3 mp4 m4a m4p m4v ogg webm ogv oga flac aac 3gp css zip xls xml gz tgz"
).split()

#: What a backup of a file adds to its name.
BACKUP_SUFFIXES = ["~", ".bak", ".bak2", ".old", ".1"]

#: Extensions that make a link a file link in a directory listing.
FILE_EXTENSIONS = (
    ".html .htm .php .asp .aspx .jsp .jspx .cgi .pl .py .rb .lua .txt .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods "
    ".odp .rtf .tex .md .csv .js .mjs .ts .jsx .tsx .css .scss .sass .less .java .class .jar .c .cpp .h .hpp .cs .vb "
    ".go .rs .swift .kt .scala .r .m .mm .f .f90 .pas .asm .sh .bash .zsh .fish .bat .cmd .ps1 .psm1 .xml .json .yaml "
    ".yml .toml .ini .conf .config .cfg .properties .env .sql .db .sqlite .mdb .accdb .zip .rar .7z .tar .gz .bz2 .xz "
    ".tgz .tbz2 .cab .dmg .iso .img .exe .dll .so .dylib .app .deb .rpm .apk .msi .jpg .jpeg .png .gif .bmp .svg .webp "
    ".ico .tif .tiff .psd .ai .eps .raw .cr2 .nef .mp3 .wav .flac .aac .ogg .wma .m4a .opus .aiff .mp4 .avi .mkv .mov "
    ".wmv .flv .webm .m4v .mpg .mpeg .3gp .ogv .ttf .otf .woff .woff2 .eot .log .bak .tmp .temp .swp .swo .old .orig "
    ".backup"
).split()

#: Status codes that are reported unless told otherwise.
STATUS_CODES = [
    100, 101, 102, 103, 200, 201, 202, 203, 204, 205, 206, 207, 208, 226, 300, 301, 302, 303, 304, 305, 307, 308, 400,
    401, 402, 403, 404, 405, 406, 407, 408, 409, 410, 411, 412, 413, 414, 415, 416, 417, 418, 421, 422, 423, 424, 425,
    426, 428, 429, 431, 451, 500, 501, 502, 503, 504, 505, 506, 507, 508, 510, 511,
]

#: Characters that text processing replaces by a space.
PUNCTUATION = "!\\\"#$%&()*+:;<=>?@[]^{}|~,'“”’‘/–—."

#: Signs of path traversal in a lower-case path.
TRAVERSAL_SIGNS = ["..", "%2e%2e", "%25%32%65%25%32%65", "%c0%ae%c0%ae", "%e0%40%ae%e0%40%ae", "%c0ae%c0ae", "%uff0e%uff0e", "%u002e%u002e"]

#: Fixed pattern: quoted links in script text, five kinds.
SCRIPT_LINKS = (
    r"""(?:"|')("""
    r"""(?:(?:[a-zA-Z]{1,10}://|//)[^"'/]{1,}\.[a-zA-Z]{2,}[^"']{0,})"""
    r"""|(?:(?:/|\.\./|\./)[^"'><,;|*()(%%$^/\\\[\]][^"'><,;|()]{1,})"""
    r"""|(?:[a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/.]{1,}\.(?:[a-zA-Z]{1,4}|action)(?:[\?|\#][^"|']{0,}|))"""
    r"""|(?:[a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{3,}(?:[\?|\#][^"|']{0,}|))"""
    r"""|(?:[a-zA-Z0-9_\-]{1,}\.(?:php|asp|aspx|jsp|json|action|html|js|txt|xml)(?:[\?|\#][^"|']{0,}|))"""
    r""")(?:"|')"""
)

#: Fixed pattern: paths in the allow and disallow lines of a robots file.
ROBOTS_PATHS = r"^[ \t]*(?i:allow|disallow)[ \t]*:[ \t]*([^ \t\r\n#$]*)?[ \t]*\$?(?:#.*)?$"

#: Fixed pattern: characters that a path part does not keep.
PATH_JUNK = r'["<>\\^`{|} ]'

#: English function words, the default where a caller passes no stop words.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both "
    "but by can could did do does doing down during each few for from further get got had has have having he her here "
    "hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on "
    "once only or other our ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which "
    "while who whom why will with would you your yours yourself yourselves"
).split()

#: Other defaults.
NEAR_DISTANCE, UNIQUE_DISTANCE, HIGH_ERROR_RATIO, MAX_DEPTH, SIZE_LIMIT = 3, 1, 0.90, 4, 4 << 20
