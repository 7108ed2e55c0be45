"""Defaults of the operators, in seconds and hertz. Every operator takes them as keyword arguments."""

MIN_SEGMENT, MAX_SEGMENT = 3.0, 15.0
MAX_LATENCY, MAX_OVERLAP = 1.0, 0.25
MERGE_GAP = 1.0
PAUSE = 0.2
VAD_TOLERANCE = 0.5
MIN_VOICED_RATIO = 0.05
SPLIT_FRACTIONS = {"train": 0.60, "val": 0.10, "test": 0.30}
FRAME, HOP, EPS = 0.025, 0.010, 1e-6

# Replies that do not count as turns.
BACKCHANNELS = (
    "oh", "oh.", "oh!", "oh?", "yeah", "yeah.", "yeah!", "yes", "yes.", "yep",
    "yep.", "no", "no.", "nah", "nah.", "mm-hmm", "mm-hmm.", "mmhmm", "uh-huh",
    "uh-huh.", "uh huh", "right", "right.", "okay", "okay.", "ok", "ok.",
    "cool", "cool.", "sure", "sure.", "alright", "alright.", "hmm", "hmm.",
    "hm", "hm.", "mhm", "mhm.", "wow", "wow.",
)

# Column order of the pair table.
PAIR_COLUMNS = [
    "pair_id", "session_id", "interaction_id", "dyad_id", "prompt_participant_id", "response_participant_id", "turn_index",
    "source_wav_path_prompt", "source_json_path_prompt", "source_wav_path_response", "source_json_path_response",
    "prompt_start_s", "prompt_end_s", "prompt_duration_s", "response_start_s", "response_end_s", "response_duration_s", "latency_s", "overlap_s",
    "prompt_transcript", "response_transcript", "prompt_word_count", "response_word_count",
    "relationship", "relationship_detail", "status_relationship", "status_pair", "source_dataset_split", "split", "split_seed", "split_unit",
]

# Column order of the candidate table.
CANDIDATE_COLUMNS = [
    "pair_id", "candidate_id", "session_id", "interaction_id", "dyad_id", "prompt_participant_id", "response_participant_id", "turn_index",
    "model_name", "is_original_reference", "split", "source_style", "source_dataset_split", "split_seed", "split_unit",
    "conversation_id", "speakers", "prompt_stem", "response_stem", "finish_reason", "answer_start_time", "latency_s", "overlap_s",
    "prompt_audio_path", "response_audio_path", "source_wav_path_prompt", "source_wav_path_response", "source_json_path_prompt", "source_json_path_response",
    "prompt_start_s", "prompt_end_s", "prompt_duration_s", "response_start_s", "response_end_s", "response_duration_s",
    "prompt_audio_duration_s", "response_audio_duration_s", "prompt_clip_start_s", "prompt_clip_end_s", "response_clip_start_s", "response_clip_end_s",
    "prompt_was_clipped", "response_was_clipped", "prompt_vox_compatible", "response_vox_compatible",
    "prompt_transcript", "response_transcript", "response_metadata_transcript", "response_asr_transcript", "prompt_word_count", "response_word_count",
    "relationship", "relationship_detail", "status_relationship", "status_pair", "status_prompt_audio", "status_response_audio", "status_prompt_source", "status_response_source",
]

# Key of the join between measurement tables.
MERGE_KEY_COLUMNS = [
    "session_id", "interaction_id", "dyad_id", "prompt_participant_id", "response_participant_id", "turn_index",
    "prompt_start_s", "prompt_end_s", "response_start_s", "response_end_s",
]

# Response measurements of the evaluation.
RESPONSE_TARGETS = [
    "duration_s", "word_count", "f0_sd", "f0_range", "voiced_ratio", "speech_rate_local", "articulation_rate_local",
    "pause_ratio_local", "mean_pause_duration_local", "arousal", "valence", "dominance",
]

# The tracks of a probe item with the speaker that its metadata names, and the files it must have.
PROBE_TRACKS = {"speaker1": "A", "speaker2": "B"}
PROBE_FILES = ["metadata.csv", "speaker1_track.wav", "speaker1_track.json", "speaker2_track.wav", "speaker2_track.json"]

# Column order of the probe's pair table.
PROBE_COLUMNS = [
    "pair_id", "session_id", "interaction_id", "dyad_id", "prompt_participant_id", "response_participant_id", "turn_index",
    "source_wav_path_prompt", "source_json_path_prompt", "source_wav_path_response", "source_json_path_response",
    "prompt_start_s", "prompt_end_s", "prompt_duration_s", "response_start_s", "response_end_s", "response_duration_s", "latency_s", "overlap_s",
    "prompt_transcript", "response_transcript", "prompt_word_count", "response_word_count", "relationship", "relationship_detail", "status_relationship",
    "prompt_tts_model", "response_tts_model", "prompt_is_synthetic", "response_is_synthetic", "is_human_prompt_synthetic_response",
    "row_dir", "prompt_track", "response_track", "status_pair", "source_dataset_split", "split", "split_seed", "split_unit",
]
