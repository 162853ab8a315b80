"""Rules over metadata keys (``Group:Tag``) as Column expressions: which are sensitive, and which categories they belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the sensitivity filter, by rule.
SKIPPED_GROUPS = "System ExifTool Composite".split()
ALLOWED_KEYS = """
SourceFile ExifTool:ExifToolVersion JFIF:JFIFVersion JFIF:ResolutionUnit JFIF:XResolution JFIF:YResolution File:FileName File:Directory
File:FileSize File:FileModifyDate File:FileAccessDate File:FileInodeChangeDate File:FilePermissions File:FileType File:FileTypeExtension
File:MIMEType File:ImageWidth File:ImageHeight File:ImageSize File:Megapixels File:BitsPerSample File:ColorComponents File:YCbCrSubSampling
File:EncodingProcess File:ExifByteOrder File:ID3Size Composite:ImageSize Composite:Megapixels IFD0:Orientation EXIF:Orientation
""".split()
COLOR_GROUPS = "ICC_Profile ExifIFD IFD0 EXIF PNG File".split()
COLOR_TAGS = "Color ICC WhitePoint Chromaticities Gamma TransferFunction YCbCr Primary Profile RenderingIntent".split()
STRUCTURAL = {
    r"QuickTime|Track\d+": """MajorBrand MinorVersion CompatibleBrands MovieHeaderVersion TimeScale Duration PreferredRate PreferredVolume
        PreviewTime PreviewDuration PosterTime SelectionTime SelectionDuration CurrentTime NextTrackID MediaDataSize MediaDataOffset
        TrackHeaderVersion TrackID TrackLayer TrackVolume TrackDuration MatrixStructure MediaHeaderVersion MediaTimeScale MediaDuration
        MediaLanguageCode HandlerType HandlerVendorID GraphicsMode OpColor CompressorID CompressorName SourceImageWidth SourceImageHeight
        XResolution YResolution BitDepth PixelAspectRatio BufferSize MaxBitrate AverageBitrate VideoFrameRate VideoScanType Balance
        AudioFormat AudioChannels AudioBitsPerSample AudioSampleRate ImageWidth ImageHeight Rotation""",
    r"QuickTime": r"""ColorProfiles ColorPrimaries TransferCharacteristics MatrixCoefficients VideoFullRangeFlag ImageSpatialExtent
        CleanAperture ImagePixelDepth HEVCConfigurationVersion GeneralProfileSpace GeneralTierFlag GeneralProfileIDC
        GenProfileCompatibilityFlags ConstraintIndicatorFlags GeneralLevelIDC MinSpatialSegmentationIDC ParallelismType ChromaFormat
        ChromaSamplePosition BitDepthLuma BitDepthChroma AverageFrameRate ConstantFrameRate NumTemporalLayers TemporalIDNested
        AV1ConfigurationVersion SeqProfile SeqLevelIdx0 SeqTier0 HighBitdepth TwelveBit Monochrome ChromaSubsamplingX ChromaSubsamplingY
        MaxContentLightLevel MaxPicAverageLightLevel MaxCLL MaxFALL MasteringDisplay\w* MaxLuminance MinLuminance WhitePoint\w*
        ColorRepresentation""",
    r"Matroska|Info|Track\d+": """EBMLVersion EBMLReadVersion DocType DocTypeVersion DocTypeReadVersion TimecodeScale Duration TrackNumber
        TrackUID TrackLanguage TrackType TagTrackUID CodecID CodecDelay SeekPreRoll DefaultDuration FlagLacing FlagDefault FlagForced
        MinCache MaxCache VideoFrameRate VideoScanType ImageWidth ImageHeight DisplayWidth DisplayHeight DisplayUnit AudioChannels
        AudioSampleRate AudioBitsPerSample""",
    r"RIFF": """Encoding NumChannels SampleRate AvgBytesPerSec BitsPerSample SampleSize FrameRate FrameCount MaxDataRate StreamCount
        ImageWidth ImageHeight ImageLength Planes BitDepth Compression VideoCodec VideoFrameRate VideoFrameCount AudioCodec AudioSampleRate
        AudioSampleCount Quality StreamType TotalFrameCount WebP_Flags VP8Version VP8LVersion HorizontalScale VerticalScale
        AlphaPreprocessing AlphaFiltering AlphaCompression AnimationLoopCount BackgroundColor Duration Transparency""",
    r"FLAC": "BlockSizeMin BlockSizeMax FrameSizeMin FrameSizeMax SampleRate Channels BitsPerSample TotalSamples MD5Signature",
    r"MPEG": """MPEGAudioVersion AudioLayer AudioBitrate SampleRate ChannelMode MSStereo IntensityStereo CopyrightFlag OriginalMedia
        Emphasis VBRFrames VBRBytes VBRScale""",
    r"Vorbis|Opus|Ogg|Theora": """VorbisVersion OpusVersion AudioChannels SampleRate OriginalSampleRate NominalBitrate MaximumBitrate
        MinimumBitrate OutputGain ChannelMappingFamily BlockSize0 BlockSize1 PageCount StreamCount""",
    r"PDF": "PDFVersion Linearized PageCount PageLayout PageMode TaggedPDF Encryption Language HasXFA",
    r"AIFF": "FormType NumChannels NumSampleFrames SampleSize SampleRate CompressionType CompressorName",
    r"AAC": "ProfileType SampleRate Channels ChannelConfiguration",
    r"ZIP": "ZipRequiredVersion ZipBitFlag ZipCompression ZipUncompressedSize ZipCompressedSize ZipCRC ZipFileName ZipFileCount ZipObjectCount",
    r"XML-dc": "Title Identifier IdentifierId Language",
    r"XML": """ManifestItemId ManifestItemHref ManifestItemMedia-type ManifestItemProperties SpineItemrefIdref SpineToc MetaProperty
        PackageVersion PackageUniqueIdentifier""",
}
DATE_TAGS = "CreateDate ModifyDate TrackCreateDate TrackModifyDate MediaCreateDate MediaModifyDate".split()
SENSITIVE = """
^XMP ^IPTC ^GPS ^Maker ^Photoshop ^JFIF ^ID3 ^QuickTime ^Matroska ^Info: ^RIFF ^PDF ^Keys ^ItemList ^UserData ^XML ^ZIP ^OOXML ^EPUB ^RTF
^FlashPix :GPS :XMP :IPTC Prompt Workflow Parameters NegativePrompt Seed Sampler Scheduler Model Generator Encoder Encoded Software
Application AppVersion Creator Author Artist Producer Company Manager Copyright Comment Description Title Subject Keywords CreateDate
ModifyDate CreationDate ModificationDate UserComment Instructions Credit Source History DocumentID InstanceID LastModifiedBy
RevisionNumber TotalEditTime Template Comfy Automatic1111 StableDiffusion Midjourney DALL Firefly Leonardo Ideogram Gemini
""".split()
HANDLERS = [
    "VideoHandler", "SoundHandler", "DataHandler", "SubtitleHandler", "PictureHandler", "Core Media Video", "Core Media Audio",
    "Core Media Data Handler", "Apple Video Media Handler", "Apple Sound Media Handler", "Apple Alias Data Handler",
    "GPAC ISO Video Handler", "GPAC ISO Audio Handler", "L-SMASH Video Handler", "L-SMASH Audio Handler",
]

# Categories in display order with their labels, and the words of each.
CATEGORIES = {
    "gps": "GPS location",
    "ai": "AI prompt & generation data",
    "author": "Author & copyright",
    "comments": "Comments & description",
    "software": "Software & device",
    "dates": "Timestamps",
    "thumbnail": "Embedded thumbnail",
    "document": "Document properties",
    "svg": "Scripts & unsafe SVG content",
    "metadata": "Hidden metadata",
}
AI_WORDS = """prompt parameters workflow seed sampler scheduler negativeprompt comfy automatic1111 stablediffusion midjourney dall firefly
leonardo ideogram gemini generat \\bmodel\\b""".split()
TAG_WORDS = {
    "author": r"artist author creator copyright byline credit \brights\b owner lastmodifiedby producer",
    "comments": r"comment description \btitle\b subject keywords usercomment caption headline instructions abstract",
    "dates": r"createdate modifydate datetime creationdate modificationdate \bdate\b \btime\b",
    "thumbnail": "thumbnail preview jfxx",
    "document": "company manager template revision totaledittime docprops lastprinted category contentstatus",
    "software": r"software \bmake\b \bmodel\b encoder encoded application handlerdescription writingapp muxingapp vendor toolkit",
}


def any_of(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


ALLOWED_COLOR = f"(?i)^{any_of(COLOR_GROUPS)}:.*{any_of(COLOR_TAGS)}"
STRUCTURAL_PATTERNS = [f"^({groups}):{any_of(tags.split())}$" for groups, tags in STRUCTURAL.items()]
ZEROABLE = rf"^((QuickTime|Track\d+):{any_of(DATE_TAGS)}|ZIP:ZipModifyDate|XML:Meta)$"
ZERO_DATE = r"^(0000[:-]00[:-]00[ T]00:00:00|1980[:-]01[:-]01[ T]00:00)"
MUXER_KEY = r"^(Info:(MuxingApp|WritingApp)|(Vorbis|Ogg|Opus):Vendor|AAC:Encoder)$"
MUXER_VALUE = r"(?i)^(Lavf|Lavc|ffmpeg)[0-9.]*$"
HANDLER_KEY = r"^(QuickTime|Track\d+):HandlerDescription$"
HANDLER_VALUE = f"^{any_of(HANDLERS)}$"
SENSITIVE_PATTERN = f"(?i){any_of(SENSITIVE)}"


def is_sensitive(key: Column, value: Column) -> Column:
    """Whether a metadata field must go: not allowed by any of the ordered lists, and named by the last."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    allowed = [
        key.rlike(f"^{any_of(SKIPPED_GROUPS)}:"),
        key.isin(ALLOWED_KEYS),
        key.rlike("(?i)^ICC[-_]"),
        key.rlike(ALLOWED_COLOR),
        *(key.rlike(p) for p in STRUCTURAL_PATTERNS),
        key.rlike(ZEROABLE) & value.rlike(ZERO_DATE),
        key.rlike(MUXER_KEY) & value.rlike(MUXER_VALUE),
        key.rlike(HANDLER_KEY) & value.rlike(HANDLER_VALUE),
    ]
    return F.coalesce(~reduce(lambda a, b: a | b, allowed) & key.rlike(SENSITIVE_PATTERN), F.lit(False))


def sensitive_keys(metadata: Column) -> Column:
    """The sensitive keys of a map of metadata, in its order."""
    return F.transform(F.filter(F.map_entries(metadata), lambda e: is_sensitive(e["key"], e["value"])), lambda e: e["key"])


def key_category(key: Column) -> Column:
    """The category of one key: the first whose words it holds."""
    tag = F.element_at(F.split(key, ":"), -1)
    out = F.when(key.rlike("(?i)gps"), "gps").when(key.rlike(f"(?i){any_of(AI_WORDS)}"), "ai")
    for category, words in TAG_WORDS.items():
        out = out.when(tag.rlike(f"(?i){any_of(words.split())}"), category)
    return out.otherwise("metadata")


def in_order(categories: Column) -> Column:
    """Distinct categories in display order."""
    return F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.array_contains(categories, c))


def key_categories(keys: Column) -> Column:
    return in_order(F.transform(keys, key_category))


def token_categories(token: Column) -> Column:
    """Categories of one token that a byte cleaner reports."""
    t = F.lower(token)
    many = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(t == "gps", many("gps"))
        .when(t == "author", many("author"))
        .when(t == "software", many("software"))
        .when(t == "datetime", many("dates"))
        .when(F.contains(t, F.lit("exif")), many("metadata", "dates"))
        .when(t == "xmp", many("ai", "author"))
        .when(F.startswith(t, F.lit("comment")), many("comments"))
        .when(F.contains(t, F.lit("thumbnail")) | F.contains(t, F.lit("jfxx")), many("thumbnail"))
        .when(F.contains(t, F.lit("text")), many("ai", "comments"))
        .when(t == "time", many("dates"))
        .when(t == "documentproperties", many("document", "author", "software", "dates"))
        .when(t == "epubmetadata", many("document", "author", "dates"))
        .when(t == "rtfmetadata", many("document", "author", "software"))
        .when(t == "svgmetadata", many("svg"))
        .when(t.isin("id3", "ape", "vorbiscomment", "flacpicture"), many("author", "comments"))
        .otherwise(many("metadata"))
    )


def tokens_categories(tokens: Column) -> Column:
    return in_order(F.flatten(F.transform(tokens, token_categories)))


def labels(categories: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.transform(categories, lambda c: table[c])


def summary(count: Column, categories: Column) -> Column:
    """``2 fields (GPS location, Timestamps)``, or ``no sensitive fields``."""
    text = F.format_string("%d %s (%s)", count, F.when(count == 1, "field").otherwise("fields"), F.array_join(labels(categories), ", "))
    return F.when(F.coalesce(count, F.lit(0)) == 0, "no sensitive fields").otherwise(text)


def failure_message(category: Column) -> Column:
    """What a user may be told about a failed file."""
    return (
        F.when(category == "unsafe_svg", "The SVG holds content that can't be made safe.")
        .when(category == "visual_integrity", "The cleaned file did not pass verification.")
        .when(category == "metadata_tool", "The file's metadata could not be removed.")
        .otherwise("The file could not be cleaned.")
    )


def resolve_target(target: Column) -> Column:
    """A relationship target as a part name: decoded, without its first slash, dots and parents resolved."""
    raw = F.trim(target)
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    steps = F.split(F.regexp_replace(decoded, "^/", ""), "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "") | (s == "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(walked, "/")


def anonymous_identifier(text: Column, product: str = "tidemark") -> Column:
    """``urn:<product>:`` and 32 hexadecimal digits that follow from the text alone."""
    return F.concat(F.lit(f"urn:{product}:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
