"""Names, labels, keyword lists and limits that results depend on."""

from __future__ import annotations

# Aspects in order of display, their tables and specification columns.
ASPECTS: dict[str, tuple[str, list[str]]] = {
    "display": ("dim_display", ["display_type", "color_depth", "display_standard", "resolution", "screen_size", "touch_technology"]),
    "camera": ("dim_camera", ["rear_camera", "front_camera", "flash_light", "camera_features", "video_recording", "video_call"]),
    "performance": ("dim_performance", ["cpu_speed", "core_count", "chipset", "ram_capacity", "gpu_chip"]),
    "storage": ("dim_storage", ["phonebook_storage", "internal_storage", "external_memory", "max_external_support"]),
    "design": ("dim_design", ["design_style", "dimensions", "weight"]),
    "battery": ("dim_battery", ["battery_type", "battery_capacity", "removable_battery"]),
    "connectivity": (
        "dim_connectivity",
        ["network_3g", "network_4g", "sim_type", "sim_slots", "wifi", "gps", "bluetooth", "gprs_edge", "headphone_jack", "nfc", "usb_connection", "other_connections", "charging_port"],
    ),
    "utilities": ("dim_utilities", ["movie_playback", "music_playback", "charging_port_alt", "voice_recorder", "fm_radio", "other_features"]),
}

# Labels of the specification page by field; a second label is the fallback.
SPEC_LABELS: dict[str, tuple[str, ...]] = {
    "os_version": ("Hệ điều hành",),
    "language_support": ("Ngôn ngữ",),
    "display_type": ("Loại màn hình",),
    "color_depth": ("Màu màn hình",),
    "display_standard": ("Chuẩn màn hình",),
    "resolution": ("Độ phân giải",),
    "screen_size": ("Màn hình rộng",),
    "touch_technology": ("Công nghệ cảm ứng",),
    "rear_camera": ("Camera sau",),
    "front_camera": ("Camera trước",),
    "flash_light": ("Đèn Flash",),
    "camera_features": ("Tính năng camera",),
    "video_recording": ("Quay phim",),
    "video_call": ("Videocall",),
    "cpu_speed": ("Tốc độ CPU",),
    "core_count": ("Số nhân",),
    "chipset": ("Chipset",),
    "ram_capacity": ("RAM",),
    "gpu_chip": ("Chip đồ họa (GPU)", "GPU"),
    "phonebook_storage": ("Danh bạ",),
    "internal_storage": ("Bộ nhớ trong (ROM)",),
    "external_memory": ("Thẻ nhớ ngoài",),
    "max_external_support": ("Hỗ trợ thẻ tối đa",),
    "design_style": ("Kiểu dáng",),
    "dimensions": ("Kích thước",),
    "weight": ("Trọng lượng (g)",),
    "battery_type": ("Loại pin",),
    "battery_capacity": ("Dung lượng pin",),
    "removable_battery": ("Pin có thể tháo rời",),
    "network_3g": ("3G",),
    "network_4g": ("4G",),
    "sim_type": ("Loại Sim",),
    "sim_slots": ("Khe gắn Sim",),
    "wifi": ("Wifi",),
    "gps": ("GPS",),
    "bluetooth": ("Bluetooth",),
    "gprs_edge": ("GPRS/EDGE",),
    "headphone_jack": ("Jack tai nghe",),
    "nfc": ("NFC",),
    "usb_connection": ("Kết nối USB",),
    "other_connections": ("Kết nối khác",),
    "charging_port": ("Cổng sạc",),
    "movie_playback": ("Xem phim",),
    "music_playback": ("Nghe nhạc",),
    "charging_port_alt": ("Cổng sạc",),
    "voice_recorder": ("Ghi âm",),
    "fm_radio": ("FM radio",),
    "other_features": ("Chức năng khác",),
}

# Keywords by aspect.
KEYWORDS: dict[str, list[str]] = {
    "camera": [
        "camera", "chụp", "ảnh", "zoom", "selfie", "quay", "phim", "góc rộng", "telephoto", "chụp đêm", "chụp ngày",
        "xóa phông", "chân dung", "ống kính", "siêu rộng", "macro", "cam", "chụp hình", "camera trước", "camera sau",
        "cam trước", "cam sau", "quay video", "lấy nét", "thiếu sáng", "photo", "picture", "shoot", "lens", "portrait",
        "video", "footage", "nightmode", "bokeh", "ultrawide", "snapshot",
    ],
    "battery": [
        "pin", "sạc", "hao pin", "nạp điện", "sạc nhanh", "sạc không dây", "cạn pin", "trâu pin", "pin trâu",
        "thời lượng pin", "trâu", "tụt", "tuột", "hao", "bin", "sạc pin", "hết pin", "pin tụt", "pin khỏe", "qua đêm",
        "nhanh hết", "tụt nhanh", "pin tuột", "mau hết", "battery", "charge", "charging", "drain", "fast charge",
        "wireless charge", "battery life", "power bank",
    ],
    "display": [
        "màn hình", "màn", "độ sáng", "tần số quét", "ám vàng", "burn-in", "tấm nền", "độ phân giải", "notch", "đục lỗ",
        "oled", "amoled", "lcd", "hiển thị", "phân giải", "rực rỡ", "screen", "display", "nit", "refresh rate",
        "resolution", "panel", "brightness", "pwm", "punchhole",
    ],
    "performance": [
        "hiệu năng", "lag", "mượt", "chậm", "giật", "nóng máy", "đơ", "nhanh", "hiệu suất", "tản nhiệt", "chip",
        "vi xử lý", "xử lý", "ram", "game", "chơi game", "cấu hình", "chơi", "liên quân", "pubg", "giật lag",
        "ứng dụng", "đa nhiệm", "phần mềm", "khởi động", "lướt web", "snapdragon", "dimensity", "cpu", "gpu",
        "processor", "benchmark", "smooth", "heating", "throttle", "performance", "helio", "gaming", "freeze",
    ],
    "design": [
        "thiết kế", "mỏng", "nhẹ", "nặng", "màu sắc", "vỏ máy", "kính", "nhôm", "titan", "nhựa", "sang trọng",
        "ngoại hình", "mặt lưng", "vừa tay", "mẫu mã", "kiểu dáng", "nhỏ gọn", "mỏng nhẹ", "bắt mắt", "cầm chắc",
        "lưng nhựa", "thời trang", "design", "build quality", "color", "weight", "thin", "premium", "glass", "aluminum",
        "titanium", "finish", "aesthetic",
    ],
    "storage": [
        "bộ nhớ", "lưu trữ", "dung lượng", "rom", "thẻ nhớ", "bộ nhớ trong", "bộ nhớ ngoài", "đầy bộ nhớ", "storage",
        "sd card", "microsd", "internal storage", "capacity",
    ],
    "connectivity": [
        "wifi", "sóng", "kết nối", "sim", "mạng", "hotspot", "jack tai nghe", "bắt sóng", "bắt wifi", "sóng wifi",
        "bluetooth", "nfc", "network", "signal", "lte", "type-c", "5g", "4g", "3g",
    ],
    "utilities": [
        "tính năng", "vân tay", "chống nước", "nhận diện khuôn mặt", "loa ngoài", "âm thanh", "stereo",
        "always on display", "cảm ứng", "nhận diện", "mở khóa", "nghe nhạc", "tai nghe", "cảm biến vân tay", "face id",
        "fingerprint", "ip68", "ip67", "waterproof", "speaker", "audio", "dolby", "haptic", "aod",
    ],
}

# Patterns of numbers with units, tried where no keyword of the aspect was found.
UNIT_PATTERNS: dict[str, list[str]] = {
    "display": [r"\d+\s*hz"],
    "camera": [r"\d+\s*mp"],
    "battery": [r"\d+\s*mah", r"\d+\s*w(?:att)?(?:\s|$)"],
    "storage": [r"\d+\s*(?:gb|tb)"],
}

# Limits.
TRIGRAM_THRESHOLD, SEARCH_LIMIT, LIST_LIMIT = 0.1, 5, 20
TOP_K, OVER_FETCH, HYPOTHETICALS = 20, 5, 5
SESSION_TTL_SECONDS, HISTORY_TOKENS = 1800, 16000
CHUNK_TOKENS, CHUNK_OVERLAP, MODEL_TOKENS, MODEL_TOKENS_RETRY = 160, 20, 254, 244
COMMENTS_PER_TABLE, MIN_VIDEOS, MAX_VIDEOS = 3000, 25, 30
BLOCKED_SECONDS, CRAWL_RETRIES, CRAWL_PAGES, RECORDS_PER_PART = 600, 2, 60, 50
QUOTA_REASONS = ("quotaExceeded", "dailyLimitExceeded", "rateLimitExceeded")
CHUNK_SEPARATORS = ("\n\n", "\n", ".", "!", "?", ";", ",", " ", "")
HASH_ATTRIBUTES = ("chipset", "core_count", "ram_capacity", "gpu_chip", "dimensions", "weight", "battery_capacity")
