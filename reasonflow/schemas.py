"""Schemas of the record files and the values of their domains."""

VARIANTS = ["original", "simple", "hard"]
TAGS = ["Define", "Recall", "Derive", "Calculate", "Verify", "Conclude"]
DAG = "array<struct<step_id:int,analysis:string,depends_on:array<string>,macro_action_tag:string>>"
PAIRED = "problem_id bigint, type string, level string, " + ", ".join(f"{v} struct<problem:string,solution:string,answer:string>" for v in VARIANTS)
SAMPLE = "struct<response:string,correct:boolean>"
RECORDS = "problem_id bigint, type string, level string, " + ", ".join(f"{v} struct<problem:string,ground_truth:string,response:string,correct:boolean,samples:array<{SAMPLE}>>" for v in VARIANTS)
STEPS = "array<struct<index:int,text:string>>"
SEGMENTED = "problem_id bigint, type string, level string, " + ", ".join(f"{v} struct<problem:string,ground_truth:string,samples:array<struct<response:string,correct:boolean,steps:{STEPS},num_steps:int>>>" for v in VARIANTS)
BATCH_RESULT = "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
GED_RESULT = "problem_id bigint, sample_id string, variant string, problem string, response string, correct boolean, ged double, similarity_normalized double, timed_out boolean"
TRAINING = "problem_id bigint, problem string, response string, variant_type string, target_alpha double, ged_score double, sample_id string"
